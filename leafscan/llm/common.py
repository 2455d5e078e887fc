"""Small helpers shared by the operators: reading tables, bounded Arrow slices, text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 8 << 20
# A table with one short row for each group is broadcast by hint up to this many rows.
BROADCAST_GROUPS = 100_000
HOT_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text as a string, a null one as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def join_once(rows: DataFrame, found: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``found`` (settled, one row for each key, ``count`` telling its rows) so that no key is one task.

    Keys with ``hot_rows`` rows or more are at most rows / hot_rows: their part of ``found`` is broadcast if that is few enough, and the rest is shuffled.
    """
    hot = found.filter(F.col(count) >= hot_rows)
    n = hot.count()
    found = found.drop(count)
    if n == 0 or n > BROADCAST_GROUPS:
        return rows.join(found, key)
    hot = F.broadcast(hot.drop(count))
    keys = F.broadcast(hot.select(key))
    return rows.join(keys, key, "left_anti").join(found, key).unionByName(rows.join(hot, key))


def row_id(column: str) -> Column:
    return F.col(f"`{column}`").cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices whose ``column`` holds about ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def give_back() -> None:
    """Return the memory of finished slices to the system: a worker keeps running, and others share its machine."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@lru_cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def list_parts(array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, flat values) of a list array without nulls."""
    offsets = array.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], array.values.slice(offsets[0], offsets[-1] - offsets[0])


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each flat value the position of its list."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def codes_of(values) -> tuple[np.ndarray, int]:
    """Dense integer codes of Arrow or numpy values, equal values alike, and how many there are."""
    encoded = (values if isinstance(values, pa.Array) else pa.array(values)).dictionary_encode()
    return encoded.indices.to_numpy(), len(encoded.dictionary)


def utf8_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string array without nulls."""
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def sums_by(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range between neighbouring offsets; an empty range gives 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words) of each string; a word is a run of anything but ASCII white space."""
    offsets, flat = list_parts(pc.ascii_split_whitespace(strings))
    full = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return kept[offsets], flat.filter(full)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal integer ``keys``; the rows come sorted by them. One group is in memory at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(values[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
