"""Project metrics, ranked units, advice and decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import rulebook as rb
from ..functions import text as tx
from ..session import settle
from . import ordering
from .findings import keep_first

Keep = Callable[[DataFrame, str], DataFrame]

METRICS = (
    "units_scored", "units_with_issues", "critical_units", "high_units", "units_with_bounds", "offset_units",
    "cursor_units", "bounds_coverage_percent", "keyset_usage_percent", "offset_usage_percent",
    "stable_order_coverage_percent", "deep_offset_units", "unbounded_units", "unsafe_sort_units",
)


def project_metrics(projects: DataFrame, unit_scores: DataFrame) -> DataFrame:
    """One wide row per project; percents are null without units."""
    c = F.col

    def count(cond):
        return F.count_if(cond).cast("int")

    total = F.count(F.lit(1))

    def percent(cond):
        return tx.round_half_up(F.count_if(cond) / total * 100)

    measured = unit_scores.groupBy("project").agg(
        total.cast("int").alias("units_scored"),
        count(c("issue_count") > 0).alias("units_with_issues"),
        count(c("critical")).alias("critical_units"), count(c("high")).alias("high_units"),
        count(~c("unbounded")).alias("units_with_bounds"),
        count(c("offset")).alias("offset_units"), count(c("cursor")).alias("cursor_units"),
        percent(~c("unbounded")).alias("bounds_coverage_percent"),
        percent(c("cursor")).alias("keyset_usage_percent"),
        percent(c("offset")).alias("offset_usage_percent"),
        percent(~c("unstable_order")).alias("stable_order_coverage_percent"),
        count(c("deep_offset")).alias("deep_offset_units"),
        count(c("unbounded")).alias("unbounded_units"),
        count(c("unsafe_sort")).alias("unsafe_sort_units"))
    joined = projects.select("project").distinct().join(measured, "project", "left")
    return joined.select("project", *[
        (c(m) if m.endswith("percent") else F.coalesce(c(m), F.lit(0))).alias(m) for m in METRICS])


def _ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None) -> DataFrame:
    """``rank`` per key; with ``k`` the limit also runs before the exchange."""
    out = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


def top_units(unit_scores: DataFrame, k: int = 5) -> DataFrame:
    """The riskiest units of each project."""
    c = F.col
    primary = F.when(c("primary.file_path") != rb.PROJECT_PATH, c("primary"))
    ranked = _ranked(unit_scores, ["project"], [
        F.coalesce("max_rank", F.lit(-1)).desc(), c("score").asc(), c("issue_count").desc(), c("name").asc(),
        c("unit_ord").asc()], k)
    return ranked.select(
        "project", "rank", "unit_key", "unit_id", "name", "kind", "score", "status", "max_severity", "issue_count",
        c("primary.message").alias("primary_risk"),
        F.coalesce("entry_file", primary["file_path"]).alias("entry_file"),
        F.coalesce("entry_start", primary["line_start"]).alias("entry_line"))


def unit_view(unit_scores: DataFrame, categories: DataFrame, scope: str = "critical", sort: str = "score",
              only: str = "high") -> DataFrame:
    """A filtered unit list per project.

    A project for which the filter leaves nothing shows its unfiltered list instead. The output
    keeps every row; ``sort_value`` is its position key.
    """
    c = F.col
    rank = F.coalesce("max_rank", F.lit(0))
    base = unit_scores.withColumn("max_rank", rank)
    if scope == "critical":
        base = base.filter((c("score") < 75) | c("high"))
    category = {"bounds": "Bounds", "depth": "DepthCost"}.get(sort)
    if category:
        scores = categories.filter(c("category") == category).select("project", "unit_key", "category_score")
        base = base.join(scores, ["project", "unit_key"], "left").withColumn(
            "sort_value", F.coalesce("category_score", "score"))
    else:
        base = base.withColumn("sort_value", c("score"))
    keep = {
        "all": F.lit(True), "critical": c("max_rank") == 3, "high": c("max_rank") >= 2, "unbounded": c("unbounded"),
        "deepOffset": c("deep_offset"), "unsafeSort": c("unsafe_sort"),
    }[only]
    marked = base.withColumn("_keep", keep)
    # The fallback needs one flag per project: a small aggregate instead of a whole-project window.
    matched = marked.groupBy("project").agg(F.bool_or("_keep").alias("_matched"))
    return marked.join(matched, "project").filter(c("_keep") | ~c("_matched")).select(
        "project", "unit_key", "unit_ord", "name", "kind", "score", "status", "max_severity", "issue_count", "sort_value", "max_rank")


def order_view(view: DataFrame, keep: Keep = settle) -> DataFrame:
    """``unit_view`` with ``position``: the place in its project's list, from 1. A project's list may be longer than a task can sort."""
    sorted_by = view.withColumn("_rank", -F.col("max_rank"))
    placed = ordering.ordered(keep(sorted_by, "view"), ["project", "sort_value", "_rank", "score", "unit_ord", "unit_key"], "ordered", keep)
    return ordering.numbered(placed, "position", "project").withColumn("position", F.col("position") + 1).drop("_rank").orderBy("project", "position")


def report_findings(findings: DataFrame) -> DataFrame:
    """Per code and file the most severe finding, then the project findings."""
    c = F.col
    rank = tx.severity_rank(c("severity"))
    in_files = findings.filter(c("file_path") != rb.PROJECT_PATH)
    kept = keep_first(in_files, ["project", "code", "file_path"], F.struct(-rank, c("finding_ord")))
    both = kept.withColumn("section", F.lit(0)).unionByName(
        findings.filter(c("file_path") == rb.PROJECT_PATH).withColumn("section", F.lit(1)))
    return both.withColumns({
        "severity_rank": rank,
        "snippet_text": tx.short_snippet(c("code_snippet")),
    })


def order_report(report: DataFrame, keep: Keep = settle) -> DataFrame:
    """``report_findings`` with ``position``: the place in its project's report, from 1."""
    sorted_by = report.withColumn("_rank", F.when(F.col("section") == 0, -F.col("severity_rank")).otherwise(0))
    placed = ordering.ordered(keep(sorted_by, "report"), ["project", "section", "_rank", "finding_ord", "code"], "ordered", keep)
    return ordering.numbered(placed, "position", "project").withColumn("position", F.col("position") + 1).drop("_rank").orderBy("project", "position")


def unit_findings(grouped: DataFrame, k: int = 20) -> DataFrame:
    """The first findings of every unit by severity."""
    return _ranked(grouped, ["project", "unit_key"], [
        tx.severity_rank(F.col("severity")).desc(), F.col("finding_ord").asc()], k)


def unit_call_steps(units: DataFrame, k: int = 10) -> DataFrame:
    """The first steps of every call chain."""
    return units.select(
        "project", "unit_key", F.posexplode(F.slice("call_chain", 1, k)).alias("depth", "s")).select(
        "project", "unit_key", "depth", "s.file_path", "s.symbol", "s.line")


def _distinct_texts(findings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct texts with the position where each is first seen (combines before the exchange)."""
    return findings.filter(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(*keys, F.col(text).alias("text")).agg(
        F.min("finding_ord").alias("first_ord"))


def issues(findings: DataFrame) -> DataFrame:
    """Distinct messages per project in first-seen order."""
    return _ranked(_distinct_texts(findings, ["project"], "message"), ["project"], [F.col("first_ord")], None).select(
        "project", "rank", F.col("text").alias("issue"))


def root_causes(findings: DataFrame) -> DataFrame:
    return _ranked(_distinct_texts(findings, ["project"], "root_cause"), ["project"], [F.col("first_ord")], None).select(
        "project", "rank", F.col("text").alias("root_cause"))


def recommendations(findings: DataFrame) -> DataFrame:
    """Distinct recommendations, then the general ones whose codes occur."""
    c = F.col
    own = _distinct_texts(findings, ["project"], "recommendation").select(
        "project", "text", F.struct(F.lit(0).alias("part"), F.lit(0).alias("i"), c("first_ord").alias("ord")).alias("place"))
    general = F.array_compact(F.array(*[
        F.when(F.bool_or(c("code").isin(*codes)), F.struct(F.lit(i).alias("i"), F.lit(text).alias("text")))
        for i, (codes, text) in enumerate(rb.GENERAL_ADVICE)]))
    no_ord = F.lit(None).cast(findings.schema["finding_ord"].dataType)
    added = findings.groupBy("project").agg(general.alias("g")).select("project", F.inline("g")).select(
        "project", "text", F.struct(F.lit(1).alias("part"), c("i").alias("i"), no_ord.alias("ord")).alias("place"))
    placed = own.unionByName(added).groupBy("project", "text").agg(F.min("place").alias("place"))
    return _ranked(placed, ["project"], [c("place")], None).select(
        "project", "rank", c("text").alias("recommendation"))


def unit_advice(grouped: DataFrame, text: str, k: int = 8) -> DataFrame:
    """The first distinct root causes or recommendations of every unit."""
    return _ranked(
        _distinct_texts(grouped, ["project", "unit_key"], text), ["project", "unit_key"], [F.col("first_ord")], k
    ).select("project", "unit_key", "rank", "text")


def next_actions(metrics: DataFrame) -> DataFrame:
    """Up to three actions per project, in fixed order."""
    c = F.col
    actions = F.array_compact(F.array(
        F.when(c("unbounded_units") > 0, F.lit(rb.NEXT_ACTION_UNBOUNDED)),
        F.when(c("deep_offset_units") > 0, F.lit(rb.NEXT_ACTION_DEEP_OFFSET)),
        F.when(c("stable_order_coverage_percent") < 100, F.lit(rb.NEXT_ACTION_ORDER)),
        F.when(c("unsafe_sort_units") > 0, F.lit(rb.NEXT_ACTION_SORT))))
    return metrics.select("project", F.posexplode(F.slice(actions, 1, 3)).alias("i", "action")).select(
        "project", (c("i") + 1).alias("rank"), "action")


def hotspot_array() -> Column:
    c = F.col
    return F.array_compact(F.array(*[
        F.when(c(m) > 0, F.concat(c(m).cast("string"), F.lit(f" {label}")))
        for m, label in (("deep_offset_units", "deep-offset units"), ("unbounded_units", "unbounded units"),
                         ("unsafe_sort_units", "unsafe-sort units"))]))


def hotspots(metrics: DataFrame) -> DataFrame:
    """The non-zero risk counts of each project as short texts."""
    return metrics.select("project", F.posexplode(hotspot_array()).alias("i", "hotspot")).select(
        "project", (F.col("i") + 1).alias("rank"), "hotspot")


def with_policy(df: DataFrame, policy: DataFrame | None) -> DataFrame:
    """Policy values of each project, with defaults for projects that have none."""
    if policy is None:
        return df.withColumns({
            "max_allowed_severity": F.lit(rb.MAX_ALLOWED_SEVERITY), "enforce_strategy": F.lit(None).cast("string")})
    rows = policy.select("project", "max_allowed_severity", "enforce_strategy")
    return df.join(rows, "project", "left").withColumn(
        "max_allowed_severity", F.coalesce("max_allowed_severity", F.lit(rb.MAX_ALLOWED_SEVERITY)))


def gate_severity(findings: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """Findings above the allowed severity."""
    c = F.col
    return with_policy(findings, policy).filter(
        tx.severity_rank(c("severity")) > tx.severity_rank(c("max_allowed_severity")))


def gate_strategy(strategies: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """Projects whose strategy differs from the enforced one."""
    c = F.col
    return with_policy(strategies, policy).filter(
        c("enforce_strategy").isNotNull() & (c("enforce_strategy") != "") & (c("detected_strategy") != "none")
        & (c("detected_strategy") != c("enforce_strategy")))


def gate_verdicts(projects: DataFrame, findings: DataFrame, strategies: DataFrame,
                  policy: DataFrame | None = None) -> DataFrame:
    """Both gates as one row per project."""
    severe = gate_severity(findings, policy).groupBy("project").agg(F.count(F.lit(1)).alias("violations"))
    wrong = gate_strategy(strategies, policy).select("project", F.lit(True).alias("strategy_violation"))
    joined = projects.select("project").distinct().join(severe, "project", "left").join(wrong, "project", "left")
    violations = F.coalesce("violations", F.lit(0))
    strategy = F.coalesce("strategy_violation", F.lit(False))
    return joined.select(
        "project", violations.alias("violations"), strategy.alias("strategy_violation"),
        ((violations > 0) | strategy).alias("failed"))
