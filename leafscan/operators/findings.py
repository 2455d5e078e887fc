"""From detector hits to findings: rule texts, order, dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import rulebook as rb
from ..schema import FINDINGS, conform


def to_findings(hits: DataFrame) -> DataFrame:
    """Attach code, severity and texts (27 fixed rows, broadcast) and the position in the order."""
    texts = F.broadcast(rb.rule_texts_table(hits.sparkSession))
    joined = hits.join(texts, "rule_id")
    return conform(joined.withColumns({
        "strategy": F.coalesce("strategy_seen", "strategy"),
        "finding_ord": F.struct(
            F.col("grp").alias("grp"), F.col("file_path").alias("file_path"), F.col("detector").alias("detector"),
            F.col("start").alias("start"), (-F.col("stop")).alias("neg_end"), F.col("rule_rank").alias("rule_rank")),
        "confidence": F.lit(None).cast("double"),
    }), FINDINGS)


def keep_first(df: DataFrame, keys: list, order) -> DataFrame:
    """First row per key. The rank limit runs before the exchange, so a hot key sends one row per task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per project, code, file and message; the first wins, lines are ignored."""
    return keep_first(findings, ["project", "code", "file_path", "message"], F.col("finding_ord"))


# Three short columns a row: some 10 MB as a hash table in each executor.
BROADCAST_RULES = 100_000


def rules_of(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The rule table to join with findings by code. A code may hold most findings, so a table of few rules is broadcast; it is counted first."""
    if rules is None:
        return F.broadcast(rb.rules_table(findings.sparkSession))
    return F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
