"""Token ids as ORC: integer run-length encoding, stripes with row indexes, Bloom filters on document ids.

Documents are sorted by id over all files, encoded, and written with the number of ids and the ids before them in their file. ORC's own
integer encoding packs the ids; each stripe has an index entry for every ``stride`` rows with the smallest and largest id and a Bloom filter
of the ids, so ``read_documents`` skips files, stripes and row groups by their metadata. A file's stripes are read by different tasks.
The place of a document in the whole row of ids is the prefix sum of the files' totals plus its place in the file.

Null texts are empty, null ids come first, rows that repeat an id follow each other (split over files by a hash of the text if they are many),
empty tables give an empty folder of files and no rows, other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leafscan.llm import common as c, subwords
from leafscan.llm.packing import PLACES
from leafscan.session import settle, shared_folder

SCHEMA = "doc_id long, before long, n_tokens int, ids array<int>"


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2,
              stride: int = 1000, stripe_bytes: int = 16 << 20, fpp: float = 0.01) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending order of the document ids."""
    vocabulary = vocabulary or subwords.public_path("byte_bpe_50k.json")

    def work(batches):
        before, encode = 0, subwords.encoder(vocabulary).encode
        for batch in c.slices(batches, "text"):
            counts, ids = subwords.with_end(*encode(batch.column("text")), end_id)
            ends = np.cumsum(counts)
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int64()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(before + ends - counts), pa.array(counts.astype(np.int32)), lists.cast(pa.list_(pa.int32()))],
                ["doc_id", "before", "n_tokens", "ids"])
            before += int(counts.sum())

    slim = docs.select(c.row_id(id_col).alias("doc_id"), c.text_of(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(work, SCHEMA).write
     .option("maxRecordsPerFile", 0).option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", stride)
     .option("orc.stripe.size", stripe_bytes).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", fpp).orc(path))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return spark.read.schema(SCHEMA).orc(path).select("*", number.alias("file"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; files, stripes and row groups without them are skipped by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``start``, the ids of all documents before. Totals come from one narrow column."""
    totals = _rows(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    bases = settle(totals.select("file", F.coalesce(
        F.sum("_total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base")), "bases")
    if bases.count() <= PLACES:
        bases = F.broadcast(bases)
    return _rows(spark, path).join(bases, "file").select("doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_checksum(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned crc32 of the ids as little-endian 32-bit integers."""
    def work(batches):
        for batch in batches:
            offsets, ids = c.list_parts(batch.column("ids"))
            raw = memoryview(np.ascontiguousarray(ids.to_numpy().astype("<u4"))).cast("B")
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens").cast(pa.int64()), pa.array(sums, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write all documents to a fresh folder below the shared one and read them back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/leafscan/{uuid.uuid4().hex}/ids.orc"
    write_ids(docs, path, id_col, text_col, vocabulary)
    return with_checksum(read_ids(spark, path))
