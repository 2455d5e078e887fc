"""Sinks and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rulebook as rb
from ..operators import metrics
from .audit import Audit

SNAPSHOT_TABLES = (
    "findings", "issues", "recommendations", "units", "unit_scores", "project_categories", "project_metrics", "top_units",
    "next_actions",
)


def _listed(df: DataFrame, value: str, name: str, k: int | None = None) -> DataFrame:
    """Ranked texts of each project as one array; their number is bounded by the rule texts."""
    rows = df if k is None else df.filter(F.col("rank") <= k)
    return rows.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("rank", F.col(value).alias("v")))).alias("a")).select(
        "project", F.transform("a", lambda x: x["v"]).alias(name))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def audit_json(a: Audit) -> DataFrame:
    """The report as JSON lines ``(project, section, ord, json)``.

    The ``report`` line holds every field of bounded size. Findings and units of a project are
    unbounded, so each is a line of its own instead of one huge document built in one task.
    """
    c = F.col
    m = a.project_metrics
    breakdown = F.struct(*[c(x).alias(_camel(x)) for x in metrics.METRICS])
    cats = a.project_categories.groupBy("project").agg(
        F.sort_array(F.collect_list(F.struct("category", "score"))).alias("categories"))
    top = a.top_units.groupBy("project").agg(F.sort_array(F.collect_list(F.struct(
        "rank", c("unit_key").alias("id"), "name", "kind", "score", "status", c("max_severity").alias("maxSeverity"),
        c("issue_count").alias("issueCount"), c("primary_risk").alias("primaryRisk"),
        c("entry_file").alias("entryFile"), c("entry_line").alias("entryLine")))).alias("topUnits"))
    report = a.project_scores.join(a.project_context, "project").join(a.strategies, "project").join(
        m.select("project", breakdown.alias("metrics")), "project")
    for extra in (cats, top, _listed(a.issues, "issue", "issues"), _listed(a.root_causes, "root_cause", "rootCauses"),
                  _listed(a.recommendations, "recommendation", "recommendations"),
                  _listed(a.next_actions, "action", "nextActions")):
        report = report.join(extra, "project", "left")

    def listed(name):
        return F.coalesce(c(name), F.array().cast("array<string>")).alias(name)

    head = report.select("project", F.lit("report").alias("section"), F.lit(0).cast("bigint").alias("ord"), F.to_json(F.struct(
        F.lit(rb.SCHEMA_VERSION).alias("schemaVersion"), c("project"), c("backend_root").alias("backendRoot"), "orm",
        c("detected_strategy").alias("detectedStrategy"), "score", "status", listed("issues"), listed("rootCauses"),
        listed("recommendations"), c("files_scanned").alias("filesScanned"),
        F.struct(F.map_from_entries(F.coalesce("categories", F.array().cast("array<struct<category:string,score:int>>"))).alias("categories"),
                 *[c(f"metrics.{_camel(x)}") for x in metrics.METRICS]).alias("breakdown"),
        "metrics", F.coalesce("topUnits", F.array().cast(report.schema["topUnits"].dataType)).alias("topUnits"), listed("nextActions"),
    ), {"ignoreNullFields": "true"}).alias("json"))
    findings = a.findings.select(
        "project", F.lit("finding").alias("section"), F.xxhash64("file_path", "code", "message").alias("ord"), F.to_json(F.struct(
            "code", "severity", "message", c("file_path").alias("filePath"),
            F.array("line_start", "line_end").alias("lineRange"), c("code_snippet").alias("codeSnippet"), "strategy",
            c("root_cause").alias("rootCause"), "recommendation", "evidence", "layer", c("unit_key").alias("unitId"), "category",
        ), {"ignoreNullFields": "true"}).alias("json"))
    units = unit_lines(a).select("project", F.lit("unit").alias("section"), F.xxhash64("unit_key").alias("ord"), F.to_json(F.struct(
        c("unit_key").alias("id"), "kind", "name", "entry", c("call_chain").alias("callChain"), "files", "categories", "score", "status", "weight"),
        {"ignoreNullFields": "true"}).alias("json"))
    return head.unionByName(findings).unionByName(units)


def unit_lines(a: Audit) -> DataFrame:
    """Units with their entry, the files their findings come from (the entry's first) and their category scores."""
    c = F.col
    files = a.findings.select("project", "unit_key", "file_path").distinct().groupBy("project", "unit_key").agg(F.sort_array(F.collect_list("file_path")).alias("_files"))
    cats = a.unit_categories.groupBy("project", "unit_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "category_score")))).alias("categories"))
    units = a.unit_scores.join(files, ["project", "unit_key"], "left").join(cats, ["project", "unit_key"], "left")
    own = F.when(c("entry_file").isNull(), F.array().cast("array<string>")).otherwise(F.array("entry_file"))
    lines = F.when(c("entry_start").isNotNull(), F.array("entry_start", F.coalesce("entry_end", "entry_start")))
    return units.withColumns({
        "files": F.concat(own, F.array_except(F.coalesce("_files", F.array().cast("array<string>")), own)),
        "entry": F.when(c("entry_file").isNotNull(), F.struct(c("entry_file").alias("filePath"), lines.alias("lineRange")))})


def write_json(a: Audit, path: str) -> None:
    """One folder per section, one line per object."""
    audit_json(a).select("section", F.col("json").alias("value")).write.mode("overwrite").partitionBy("section").text(path)


def write_snapshot(a: Audit, path: str, run_id: str) -> None:
    """Keep the result tables of a run, sorted by project."""
    for name in SNAPSHOT_TABLES:
        # Sorted runs of projects: a reader of one project skips row groups, a task writes one file, and a large project is several runs.
        table = getattr(a, name)
        whole = F.xxhash64(*[x.name for x in table.schema if x.dataType.typeName() != "map"])
        table.withColumn("_hash", whole).repartitionByRange("project", "_hash").sortWithinPartitions("project").drop("_hash").write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")
    stamp = a.projects.select("project", F.lit(run_id).alias("run_id"), F.current_timestamp().alias("written_at"))
    # The run's projects come last: a run without them is not finished and is never read.
    stamp.write.mode("overwrite").parquet(f"{path}/runs/run_id={run_id}")


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """Numbered recommendations of the last finished run of each project.

    ``state`` is ``listed`` or ``clean`` (a run without recommendations); a project, or a path,
    without a run has no rows.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):  # no snapshot was ever written
        return spark.createDataFrame([], "project STRING, state STRING, rank INT, recommendation STRING")
    runs = spark.read.parquet(f"{path}/runs")
    last = runs.groupBy("project").agg(F.max_by("run_id", F.struct("written_at", "run_id")).alias("run_id"))
    kept = spark.read.schema("project STRING, rank INT, recommendation STRING, run_id STRING").parquet(f"{path}/recommendations")
    return last.join(kept, ["project", "run_id"], "left").select(
        "project", F.when(F.col("rank").isNull(), "clean").otherwise("listed").alias("state"), "rank", "recommendation")


def audit_summary(a: Audit) -> DataFrame:
    """Score, strategy, files, hotspots, three units, four issues, three recommendations."""
    c = F.col
    place = F.when(
        c("entry_file").isNotNull() & c("entry_line").isNotNull(),
        F.concat_ws(":", "entry_file", c("entry_line").cast("string"))).otherwise("<unknown>")
    line = F.concat(c("name"), F.lit(" ["), F.coalesce("max_severity", F.lit("low")), F.lit("] issues="),
                    c("issue_count").cast("string"), F.lit(" @ "), place)
    units = a.top_units.select("project", "rank", line.alias("line"))
    out = a.project_scores.join(a.strategies, "project").join(
        a.files_scanned, "project", "left").join(
        a.project_metrics.select("project", metrics.hotspot_array().alias("hotspots")), "project")
    for extra in (_listed(units, "line", "top", 3), _listed(a.issues, "issue", "first_issues", 4),
                  _listed(a.recommendations, "recommendation", "quick_wins", 3)):
        out = out.join(extra, "project", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "project", F.concat(F.lit("Score: "), c("score").cast("string"), F.lit("/100 ("), c("status"), F.lit(")")).alias("headline"),
        F.concat(F.lit("Strategy: "), c("detected_strategy"), F.lit(" | Files: "), F.coalesce("files_scanned", F.lit(0)).cast("string")).alias("scope"),
        F.array_join("hotspots", " | ").alias("hotspots"),
        *[F.array_join(F.coalesce(x, none), "\n").alias(x) for x in ("top", "first_issues", "quick_wins")])
