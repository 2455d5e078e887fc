"""Project signals, project-level findings and the detected strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rulebook as rb
from .findings import dedupe_findings, to_findings

PAGINATED_CODES = ("OFFSET_USED", "UNSTABLE_CURSOR", "NO_ORDER_BY", "MISSING_LIMIT")


def _has(code: str) -> Column:
    return F.coalesce(F.bool_or(F.col("code") == code), F.lit(False))


def uses_offset() -> Column:
    return F.coalesce((F.col("strategy") == "offset"), F.lit(False)) | (F.col("code") == "OFFSET_USED")


def uses_cursor() -> Column:
    return F.coalesce((F.col("strategy") == "cursor"), F.lit(False)) | (F.col("code") == "UNSTABLE_CURSOR")


def _project_flags(findings: DataFrame) -> DataFrame:
    """Per file first, then per project; both levels combine before their exchange."""
    per_file = findings.groupBy("project", "file_path").agg(
        F.bool_or(F.col("code").isin(*PAGINATED_CODES)).alias("paginated"),
        _has("NO_PAGE_SIZE_CAP").alias("uncapped"),
        F.bool_or(uses_offset()).alias("has_offset"), F.bool_or(uses_cursor()).alias("has_cursor"),
        F.count_if(F.col("code") == "MISSING_LIMIT").alias("missing_limits"),
        _has("UNSTABLE_CURSOR").alias("unstable"), _has("OFFSET_USED").alias("offset_code"),
        _has("NO_ORDER_BY").alias("no_order"), _has("DYNAMIC_SORT_UNSAFE").alias("dynamic_sort"))
    flags = ("has_offset", "has_cursor", "paginated", "unstable", "offset_code", "no_order", "dynamic_sort")
    return per_file.groupBy("project").agg(
        *[F.bool_or(x).alias(x) for x in flags],
        F.count_if(F.col("paginated") & ~F.col("uncapped")).alias("files_with_cap"),
        F.count_if(F.col("paginated") & F.col("uncapped")).alias("files_without_cap"),
        F.sum("missing_limits").alias("unbounded_endpoints"))


def signals(raw_findings: DataFrame) -> DataFrame:
    """M01, from the findings before any dedupe."""
    return _project_flags(raw_findings).select(
        "project", "has_offset", "has_cursor",
        (F.col("has_offset") | F.col("has_cursor") | F.col("paginated")).alias("has_any_pagination"),
        "files_with_cap", "files_without_cap", "unbounded_endpoints")


def project_findings(raw_findings: DataFrame) -> DataFrame:
    """Findings about a whole project."""
    c = F.col
    rules = {
        "M02": (c("files_with_cap") > 0) & (c("files_without_cap") > 0),
        "M03": c("unbounded_endpoints") > 1,
        "M04": c("unstable") | (c("offset_code") & c("no_order")),
        "M05": c("no_order") | c("dynamic_sort"),
    }
    fired = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]))
    none = F.lit(None).cast("string")
    return to_findings(_project_flags(raw_findings).select("project", F.explode(fired).alias("rule_id")).select(
        "project", F.lit(rb.PROJECT_PATH).alias("file_path"), "rule_id", F.lit(2).alias("grp"),
        F.lit(0).alias("detector"), F.lit(0).alias("start"), F.lit(0).alias("stop"),
        F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), none.alias("code_snippet"),
        none.alias("strategy_seen"), none.alias("evidence")))


def enrich(raw_findings: DataFrame) -> DataFrame:
    """Raw findings plus project findings, deduped."""
    return dedupe_findings(raw_findings.unionByName(project_findings(raw_findings)))


def detected_strategy(findings: DataFrame) -> DataFrame:
    """Offset, cursor or mixed; projects without findings have no row (strategy none)."""
    offset, cursor = F.bool_or(uses_offset()), F.bool_or(uses_cursor())
    return findings.groupBy("project").agg(
        F.when(offset & cursor, "mixed").when(offset, "offset").when(cursor, "cursor").otherwise("none").alias("detected_strategy"))
