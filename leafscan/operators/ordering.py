"""Places in a global order without a single sorting task: range partitions, written once, and prefix sums over the partitions' totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle

_BEFORE = (Window.unboundedPreceding, -1)


def ordered(rows: DataFrame, order: list[str], name: str, keep: Callable[[DataFrame, str], DataFrame] = settle) -> DataFrame:
    """``rows`` (settled by the caller, so a lost task gives them again) sorted by ``order``, with ``_part`` and the place ``_at`` in it.

    ``order`` has to tell the rows of a hot key apart: they are then split over partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return keep(placed.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_id"), name)


def numbered(placed: DataFrame, into: str, group: str | None = None) -> DataFrame:
    """Result of ``ordered`` with ``into``: the number from 0 in the whole order, or in each ``group`` (not null) that the order keeps together.

    One small row for each partition, or for each group in a partition, carries the rows before it.
    """
    keys = ["_part"] if group is None else [group, "_part"]
    totals = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    window = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_part").rowsBetween(*_BEFORE)
    base = totals.select(*keys, (F.coalesce(F.sum("_n").over(window), F.lit(0)) - F.col("_first")).alias("_base"))
    return placed.join(base, keys).withColumn(into, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
