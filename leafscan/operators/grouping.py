"""Assigning findings to units."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..schema import FINDINGS, UNITS, conform
from .findings import keep_first, rules_of


def classify(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Layer from the path, category from the rule table; preset values stay."""
    category = rules_of(findings, rules).select("code", F.col("category").alias("_category"))
    # The normal path is a column first: inside the layer's conditions it would be worked out for each of their fragments.
    return findings.withColumn("_path", tx.normal_path(F.col("file_path"))).join(category, "code", "left").withColumns({
        "layer": F.coalesce("layer", tx.layer_of(F.col("_path"))),
        "category": F.coalesce("category", "_category"),
    }).drop("_category", "_path")


def _by_unit_id(units: DataFrame) -> DataFrame:
    return units.groupBy("project", "unit_id").agg(
        F.min_by("unit_key", "unit_ord").alias("preset_key"))


def _by_file(units: DataFrame) -> DataFrame:
    """The first unit of each file and the last line that any unit of it reaches."""
    return units.filter("entry_file IS NOT NULL").groupBy("project", F.col("entry_file").alias("file_path")).agg(
        F.min_by("unit_key", "unit_ord").alias("first_key"), F.max("entry_end").alias("last_line"))


def _blocks(units: DataFrame) -> DataFrame:
    """(project, file_path, level, block, u): the first unit that covers a block of 2^level lines with one of its own blocks.

    A range of lines is a union of at most two aligned blocks a level, so units and lines meet in an equi-join on blocks: a line lies in one block
    of each level.
    """
    c = F.col
    ranges = units.filter("entry_file IS NOT NULL AND entry_start <= entry_end").select(
        "project", c("entry_file").alias("file_path"), F.struct("unit_ord", "unit_key").alias("u"), c("entry_start").alias("_s"), (c("entry_end") + 1).alias("_e"),
        F.explode(F.sequence(F.lit(0), F.floor(F.log2(c("entry_end") - c("entry_start") + 1)).cast("int"))).alias("level"))
    size = F.expr("shiftleft(1, level)")
    cut = ranges.withColumn("_l", F.floor((c("_s") + size - 1) / size).cast("int")).withColumn("_r", F.floor(c("_e") / size).cast("int")).filter("_l < _r")
    found = cut.withColumn("block", F.explode(F.array_compact(F.array(F.when(c("_l") % 2 == 1, c("_l")), F.when(c("_r") % 2 == 1, c("_r") - 1)))))
    return found.groupBy("project", "file_path", "level", "block").agg(F.min("u").alias("u"))


def _by_line(places: DataFrame, units: DataFrame, by_file: DataFrame) -> DataFrame:
    """(project, file_path, _line, line_key): the first unit whose range holds a line that has findings."""
    c = F.col
    near = places.select("project", "file_path", "_line").distinct().join(by_file, ["project", "file_path"]).filter("_line BETWEEN 1 AND last_line")
    levels = near.select("project", "file_path", "_line", F.explode(F.sequence(F.lit(0), F.floor(F.log2(c("last_line"))).cast("int"))).alias("level"))
    asked = levels.withColumn("block", F.floor(c("_line") / F.expr("shiftleft(1, level)")).cast("int"))
    met = asked.join(_blocks(units), ["project", "file_path", "level", "block"])
    return met.groupBy("project", "file_path", "_line").agg(F.min("u").alias("u")).select("project", "file_path", "_line", c("u.unit_key").alias("line_key"))


def _by_chain(units: DataFrame) -> DataFrame:
    """The first unit whose call chain passes through a file (case-insensitive)."""
    steps = units.select("project", "unit_key", "unit_ord", F.explode("call_chain.file_path").alias("step_file"))
    return steps.groupBy("project", tx.normal_path(F.col("step_file")).alias("path_key")).agg(
        F.min_by("unit_key", "unit_ord").alias("chain_key"))


def _of_places(places: DataFrame, units: DataFrame) -> DataFrame:
    """J01-J04 for each place: preset unit, unit in the file, call chain, file unit."""
    c = F.col
    # Null ids meet nothing; spreading them keeps the left join free of one huge null key.
    preset = places.withColumn("_preset", F.coalesce("unit_id", F.concat(F.lit("\u0000"), "file_path")))
    by_file = _by_file(units)
    joined = (
        preset.join(_by_unit_id(units).withColumnRenamed("unit_id", "_preset"), ["project", "_preset"], "left")
        .join(by_file.drop("last_line"), ["project", "file_path"], "left")
        .join(_by_line(places, units, by_file), ["project", "file_path", "_line"], "left")
        .withColumn("path_key", tx.normal_path(c("file_path")))
        .join(_by_chain(units), ["project", "path_key"], "left"))
    in_file = F.coalesce("line_key", "first_key")
    unit_key = F.coalesce("preset_key", in_file, "chain_key", F.concat(F.lit("file:"), "file_path"))
    how = (
        F.when(c("preset_key").isNotNull(), "preset").when(in_file.isNotNull(), "file")
        .when(c("chain_key").isNotNull(), "chain").otherwise("fallback"))
    return joined.select("project", "file_path", "unit_id", "_line", unit_key.alias("unit_key"), how.alias("assigned_by"))


def assign_units(findings: DataFrame, units: DataFrame) -> DataFrame:
    """J01-J04 as one row-preserving plan.

    What decides on the unit are four short columns. Each place (project, file, line, preset unit) goes through the four joins once, and the
    findings with all their texts meet the places in a single exchange instead of one for each of these joins.
    """
    rows = findings.withColumn("_line", F.coalesce("line_start", F.lit(1)))
    keys = ["project", "file_path", "unit_id", "_line"]
    found = _of_places(rows.select(*keys).distinct(), units).select(*[F.col(k).alias(f"_of_{k}") for k in keys], "unit_key", "assigned_by")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(found, same, "left").select(*findings.columns, "unit_key", "assigned_by")


def file_units(assigned: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """One synthetic unit per file whose findings met no other unit.

    ``roots(project, root)`` makes their names relative to the backend root.
    """
    c = F.col
    left = assigned.filter("assigned_by = 'fallback'").select("project", "file_path", "unit_key").distinct()
    if roots is not None:
        left = left.join(roots.select("project", "root"), "project", "left")
    else:
        left = left.withColumn("root", F.lit(None).cast("string"))
    relative = tx.relative_path(c("file_path"), c("root"))
    return conform(left.select(
        "project", "unit_key", c("unit_key").alias("unit_id"),
        F.struct(F.lit(1).alias("grp"), F.lit(0).alias("candidate_rank"), c("file_path").alias("file_path"),
                 F.lit(0).alias("kind_rank"), F.lit(0).alias("start")).alias("unit_ord"),
        F.lit("function").alias("kind"),
        F.when(F.length(relative) > 0, relative).otherwise(tx.base_name(c("file_path"))).alias("name"),
        c("file_path").alias("entry_file")), UNITS)


def group_findings(findings: DataFrame, units: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Findings with layer, category and unit, deduped inside each unit."""
    assigned = assign_units(classify(conform(findings, FINDINGS), rules), units)
    line = F.coalesce("line_start", F.lit(1))
    return keep_first(
        assigned, ["project", "unit_key", "code", "file_path", line, "message"], F.col("finding_ord"))


def unassigned(grouped: DataFrame) -> DataFrame:
    """Always empty; kept as an invariant check."""
    return grouped.filter("unit_key IS NULL")
