"""Global orders for the operators: the library's range partitions and prefix sums, and keys that sort as asked."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leafscan.operators.ordering import numbered, ordered

__all__ = ["key_of", "numbered", "ordered"]


def key_of(column: Column) -> Column:
    """A value as a string that is never null and sorts null first, then by the bytes of its UTF-8."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))
