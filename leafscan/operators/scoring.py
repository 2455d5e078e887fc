"""Unit and project scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rulebook as rb
from ..functions import text as tx
from .findings import rules_of


def code_points(grouped: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Per unit and code: the highest points, and the first finding that reaches them."""
    dims = rules_of(grouped, rules).select("code", F.col("points").alias("base"), F.col("category").alias("_category"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    scored = grouped.join(dims, "code").filter("base > 0").withColumn("points", F.col("base") * clamped)
    rank = F.struct(-F.col("points"), F.col("finding_ord"))
    return scored.groupBy("project", "unit_key", "code").agg(
        F.max("points").alias("points"), F.min("finding_ord").alias("first_ord"),
        F.min_by(F.struct("message", F.coalesce("category", "_category").alias("category")), rank).alias("best"),
    ).select("project", "unit_key", "code", "points", "first_ord",
             F.col("best.message").alias("reason"), F.col("best.category").alias("category"))


def unit_totals(points: DataFrame) -> DataFrame:
    """Capped deduction and score of every unit with findings."""
    total = F.least(F.sum("points"), F.lit(float(rb.UNIT_DEDUCTION_CAP)))
    return points.groupBy("project", "unit_key").agg(
        F.greatest(F.lit(0), tx.round_half_up(100 - total)).alias("score"))


def unit_deductions(points: DataFrame) -> DataFrame:
    """The deductions of each unit in the order their codes first appear."""
    entry = F.struct(
        "first_ord", "code", tx.round_half_up(F.col("points")).alias("points"), "reason")
    return points.groupBy("project", "unit_key").agg(F.sort_array(F.collect_list(entry)).alias("d")).select(
        "project", "unit_key",
        F.transform("d", lambda x: F.struct(x["code"].alias("code"), x["points"].alias("points"), x["reason"].alias("reason"))).alias("deductions"))


def unit_categories(points: DataFrame) -> DataFrame:
    """Score per category that was hit; the total cap does not apply."""
    used = F.least(F.lit(100.0), F.sum("points"))
    return points.filter("category IS NOT NULL").groupBy("project", "unit_key", "category").agg(
        F.greatest(F.lit(0), tx.round_half_up(100 - used)).alias("category_score"))


def severity_profile(grouped: DataFrame) -> DataFrame:
    """Per unit: flags, issue count, highest severity and the first finding that has it."""
    c = F.col

    def any_code(*codes):
        return F.bool_or(c("code").isin(*codes))

    def strategy(name):
        return F.coalesce(c("strategy") == name, F.lit(False))

    rank = tx.severity_rank(c("severity"))
    primary = F.min_by(
        F.struct("message", "file_path", "line_start"), F.struct(-rank, c("finding_ord")))
    return grouped.groupBy("project", "unit_key").agg(
        F.count(F.lit(1)).cast("int").alias("issue_count"), F.max(rank).alias("max_rank"), primary.alias("primary"),
        F.bool_or(c("severity") == "critical").alias("critical"),
        F.bool_or(c("severity").isin("critical", "high")).alias("high"),
        any_code("MISSING_LIMIT", "NO_PAGE_SIZE_CAP").alias("unbounded"),
        F.bool_or(strategy("offset") | c("code").isin("OFFSET_USED", "DEEP_OFFSET")).alias("offset"),
        F.bool_or(strategy("cursor") | c("code").isin("UNSTABLE_CURSOR", "INFINITE_SCROLL_UNSAFE")).alias("cursor"),
        any_code("NO_ORDER_BY").alias("unstable_order"),
        any_code("DEEP_OFFSET").alias("deep_offset"),
        any_code("DYNAMIC_SORT_UNSAFE").alias("unsafe_sort"))


FLAGS = ("critical", "high", "unbounded", "offset", "cursor", "unstable_order", "deep_offset", "unsafe_sort")


def score_units(units: DataFrame, grouped: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Every unit, with or without findings (J05), with score, status, weight and flags."""
    totals = unit_totals(code_points(grouped, rules))
    joined = units.join(totals, ["project", "unit_key"], "left").join(
        severity_profile(grouped), ["project", "unit_key"], "left")
    preset = F.col("weight") if "weight" in units.columns else F.lit(None).cast("double")
    return joined.withColumns({
        "score": F.coalesce("score", F.lit(100)),
        "issue_count": F.coalesce("issue_count", F.lit(0)),
        "max_severity": tx.severity_name(F.col("max_rank")),
        "weight": F.coalesce(preset, F.when(F.col("max_rank") == 3, 1.5).when(F.col("max_rank") == 2, 1.25).otherwise(1.0)),
        **{flag: F.coalesce(flag, F.lit(False)) for flag in FLAGS},
    }).withColumn("status", tx.status_of(F.col("score")))


def project_scores(projects: DataFrame, unit_scores: DataFrame) -> DataFrame:
    """Weighted mean of the unit scores; 100 for a project without units."""
    mean = F.sum(F.col("weight") * F.col("score")) / F.greatest(F.lit(1e-9), F.sum("weight"))
    means = unit_scores.groupBy("project").agg(tx.round_half_up(mean).alias("score"))
    return projects.select("project").distinct().join(means, "project", "left").withColumn(
        "score", F.coalesce("score", F.lit(100))).withColumn("status", tx.status_of(F.col("score")))


def project_categories(unit_scores: DataFrame, categories: DataFrame) -> DataFrame:
    """Weighted mean per category over the units that have it."""
    mean = F.sum(F.col("weight") * F.col("category_score")) / F.sum("weight")
    return categories.join(unit_scores.select("project", "unit_key", "weight"), ["project", "unit_key"]).groupBy(
        "project", "category").agg(F.sum("weight").alias("_w"), tx.round_half_up(mean).alias("score")).filter(
        "_w > 0").drop("_w")
