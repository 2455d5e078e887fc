"""Packing by concatenation: documents are one endless row of ids, cut into windows of fixed length.

Two passes. The first encodes each partition of documents once, writes the ids with the running total inside the partition, and leaves one
total for each partition. The prefix sums of these totals give every partition its place in the whole row, so the second pass cuts each
document where windows end without moving any ids. A document that crosses ends is cut into boundary records: ``cut_before`` and ``cut_after``
tell that it goes on in the window before or after. Only the last window has room left.

Null texts are empty: such a document is its end id alone. Empty tables give empty results, repeated rows are packed each, other columns are
not looked at, and a text of any length is cut into as many pieces as it needs. Null ids stay null. The order is that of the files read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from leafscan.llm import common as c, subwords
from leafscan.session import settle

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean"
PLACES = 1 << 20  # rows of partition totals that are broadcast: one for each task of the first pass, 16 bytes each


def encode_partitions(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """Settled rows (part, before, doc_id, n_tokens, ids): ids as bytes, ``before`` the ids of the partition's rows before."""
    def work(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch, *found in subwords.encoded(batches, vocabulary):
            counts, ids = subwords.with_end(*found, end_id)
            ends = np.cumsum(counts)
            offsets = np.concatenate(([0], ends * 4)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(counts), part, np.int64)), pa.array(before + ends - counts), batch.column("doc_id"), pa.array(counts),
                pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())]).cast(pa.binary()),
            ], ["part", "before", "doc_id", "n_tokens", "ids"])
            before += int(counts.sum())

    slim = docs.select(c.row_id(id_col).alias("doc_id"), c.text_of(text_col).alias("text"))
    return settle(slim.mapInArrow(work, "part long, before long, doc_id long, n_tokens long, ids binary"), "encoded")


def with_global_start(encoded: DataFrame) -> DataFrame:
    """Adds ``at``, the ids of all documents before, from the prefix sums of the partitions' totals."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    bases = settle(totals.select("part", F.coalesce(
        F.sum("_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base")), "bases")
    if bases.count() <= PLACES:
        bases = F.broadcast(bases)
    return encoded.join(bases, "part").withColumn("at", F.col("_base") + F.col("before")).drop("_base")


def pack(docs: DataFrame, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: which window it lies in, where, how long it is, and with ``with_ids`` the ids themselves."""
    vocabulary = vocabulary or subwords.public_path("word_bpe_49k.json")

    def work(batches):
        for batch in c.slices(batches, "ids", c.SLICE_BYTES // 4):
            at = batch.column("at").to_numpy()
            n = batch.column("n_tokens").to_numpy()
            first = at // length
            pieces = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low, high = np.maximum(at[row], window * length), np.minimum(at[row] + n[row], (window + 1) * length)
            start = low - at[row]
            blobs = [memoryview(x.as_buffer()) for x in batch.column("ids")]
            cut = [blobs[r][4 * a:4 * (a + k)] for r, a, k in zip(row.tolist(), start.tolist(), (high - low).tolist())]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(high - low), pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                       pa.array(n[row]), pa.array(window), pa.array(low - window * length), pa.array(start > 0), pa.array(start + high - low < n[row])]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)
        c.give_back()

    placed = with_global_start(encode_partitions(docs, id_col, text_col, vocabulary, end_id))
    return placed.select("doc_id", "n_tokens", "ids", "at").mapInArrow(work, PIECES + ", ids array<int>" * with_ids)
