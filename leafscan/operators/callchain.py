"""Call chains of entry points.

Every declaration has at most one successor: the first directly called name that is declared in
another file, else the first one declared at all. With one row per declaration, following a chain
is a fixed number of equi-joins against the same table, whose exchange is shared by all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import rulebook as rb
from ..schema import CALL_STEP
from ..session import settle
from . import modules

Settle = Callable[[DataFrame, str], DataFrame]

def declarations(facts: DataFrame) -> DataFrame:
    """Top-level names of each file, first declaration first; default exports also as ``default``."""
    decl = facts.filter("fact = 'decl'").select("project", "file_path", "name", "n", "line_start", "is_default")
    named = decl.withColumn("lookup", F.explode(F.when(
        F.col("is_default"), F.array(F.col("name"), F.lit("default"))).otherwise(F.array("name"))))
    best = named.groupBy("project", "file_path", "lookup").agg(
        F.min(F.struct("n", "name", "line_start")).alias("d"))
    return best.select(
        "project", "file_path", "lookup", F.col("d.name").alias("symbol"), F.col("d.line_start").alias("line"))


def resolve(wanted: DataFrame, decls: DataFrame, bound: DataFrame) -> DataFrame:
    """``wanted(project, file_path, name)`` to the declaration the name stands for.

    What an import or a required value binds (``modules.reached``) wins; otherwise it is a name declared in the file itself.
    """
    key = ["project", "file_path", "name"]
    names = wanted.select(*key).distinct()
    local = decls.select("project", "file_path", F.col("lookup").alias("name"), F.col("file_path").alias("to_file"), "symbol", "line")
    return names.join(local.join(bound.select(*key), key, "left_anti").unionByName(bound), key)


def call_edges(facts: DataFrame, decls: DataFrame, bound: DataFrame) -> DataFrame:
    """One successor per declaration: another file first, then call order."""
    calls = facts.filter("fact = 'icall'").groupBy("project", "file_path", "owner", "name").agg(F.min("n").alias("n"))
    resolved = calls.join(resolve(calls, decls, bound), ["project", "file_path", "name"])
    step = F.struct(
        (F.col("to_file") == F.col("file_path")).cast("int").alias("same"), F.col("n"), F.col("to_file"), F.col("symbol"), F.col("line"))
    return resolved.groupBy("project", F.col("file_path").alias("from_file"), F.col("owner").alias("from_symbol")).agg(
        F.min(step).alias("s")
    ).select("project", "from_file", "from_symbol", F.col("s.to_file").alias("next_file"),
             F.col("s.symbol").alias("next_symbol"), F.col("s.line").alias("next_line"))


def bound_names(facts: DataFrame, keep: Settle = settle, aliases: DataFrame | None = None) -> DataFrame:
    """Names that imports bind, with their declarations."""
    return modules.reached(declarations(facts), modules.links_of(facts), keep, aliases)


def call_chains(units: DataFrame, facts: DataFrame, keep: Settle = settle, aliases: DataFrame | None = None) -> DataFrame:
    """Units with ``call_chain`` filled; it stops at a revisit, a dead end or the depth limit. ``keep`` writes intermediate tables."""
    decls = keep(declarations(facts), "declarations")
    bound = modules.reached(decls, modules.links_of(facts), keep, aliases)
    # Every step of the walk reads the edges again.
    edges = keep(call_edges(facts, decls, bound), "call_edges")
    entries = units.filter("entry_symbol IS NOT NULL").select(
        "project", "unit_key", F.col("entry_file").alias("file_path"), F.col("entry_symbol").alias("name"))
    step = F.struct(
        F.col("to_file").alias("file_path"), F.col("symbol").alias("symbol"), F.col("line").alias("line"))
    walk = entries.join(resolve(entries, decls, bound), ["project", "file_path", "name"]).select(
        "project", "unit_key", F.col("to_file").alias("from_file"), F.col("symbol").alias("from_symbol"),
        F.array(step.cast(CALL_STEP)).alias("call_chain"))
    for _ in range(rb.CHAIN_MAX_DEPTH - 1):
        following = F.struct(
            F.col("next_file").alias("file_path"), F.col("next_symbol").alias("symbol"),
            F.col("next_line").alias("line")).cast(CALL_STEP)
        moves = F.col("next_file").isNotNull() & ~F.array_contains("call_chain", following)
        walk = walk.join(edges, ["project", "from_file", "from_symbol"], "left").select(
            "project", "unit_key",
            # A finished walk gets a key that meets nothing; a null key would gather them all in one task.
            F.when(moves, F.col("next_file")).otherwise(F.concat(F.lit("\u0000"), "unit_key")).alias("from_file"),
            F.when(moves, F.col("next_symbol")).otherwise(F.lit("")).alias("from_symbol"),
            F.when(moves, F.concat("call_chain", F.array(following))).otherwise(F.col("call_chain")).alias("call_chain"))
    return units.drop("call_chain").join(
        walk.select("project", "unit_key", "call_chain"), ["project", "unit_key"], "left")


def call_steps(units: DataFrame) -> DataFrame:
    """Long form of the chains."""
    return units.select("project", "unit_key", F.posexplode("call_chain").alias("depth", "step")).select(
        "project", "unit_key", "depth", "step.file_path", "step.symbol", "step.line")
