"""Approximate nearest neighbours by collision counting: sorted single projections, query-centred windows, virtual rehashing.

The index is a set of blocks of vectors. Each block holds, for each of ``projections`` random directions, the projected values in ascending
order with the vectors they belong to: a sorted array for each hash function. A query's bucket is a window centred on its own projected value.
Virtual rehashing multiplies the half width by ``ratio`` round after round; a round only adds the stretch between the old and the new ends of a
window. A vector that falls into the windows of at least ``threshold`` of the projections is verified: its exact distance is computed. A
block ends a query's search when the k-th verified distance is within ``trust`` half widths of the round, as a nearer vector would
then have passed the threshold with high probability, or when everything is verified. So near groups of any size are verified whole, and
no window, bucket or candidate list is capped.

Each block meets the groups of queries one after another in a task (the stated query set against all rows); blocks are copied only where there are
fewer of them than the cluster has cores. Each block gives its k best, which a top-k (cut before its exchange) merges for each query. Every row is indexed; directions depend on the seed alone, so nothing is fitted and nothing grows on the driver.

Vectors that are null, empty, zero, of another dimension than most or have null or non-finite components take no part. Ties go to the smaller
id; null ids take no part, repeated rows are candidates each, but as a query a repeated row (id and vector) is asked once, and an id with several
vectors is asked with each and gets the k nearest to any of them; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leafscan.llm import common as c
from leafscan.session import settle

RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): the rows that take part, components as doubles."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(c.row_id(id_col).alias("vec_id"), v.alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0")
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("_size")).count()
    most = sizes.orderBy(F.desc("count"), "_size").limit(1).select("_size")
    return rows.join(F.broadcast(most), F.size("vector") == F.col("_size")).drop("_size")


def build_index(vectors: DataFrame, block_rows: int = 16384, projections: int = 32, seed: int = 7) -> DataFrame:
    """Settled blocks (block, ids, vectors, values, order): arrays as bytes. Rows are spread over blocks by a hash of their id and vector."""
    rows = settle(vectors.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, math.ceil(rows.count() / block_rows))

    def sort_projections(frame):
        frame = frame.sort_values("vec_id", kind="stable")
        x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        values = x @ directions(x.shape[1], projections, seed)
        order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
        return type(frame)({"block": [int(frame["_block"].iloc[0])], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
                            "values": [np.take_along_axis(values, order, 0).T.tobytes()], "order": [order.T.tobytes()]})

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    return settle(dealt.groupBy("_block").applyInPandas(sort_projections, "block long, ids binary, vectors binary, values binary, order binary"), "index")


def directions(size: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, projections))


def search_block(ids: np.ndarray, x: np.ndarray, values: np.ndarray, order: np.ndarray, query_ids: np.ndarray, q: np.ndarray, hashed: np.ndarray,
                 k: int, threshold: int, ratio: float, trust: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row of the block, distance) of the k best verified rows of each query; ``values`` sorted for each projection."""
    n, m = x.shape[0], values.shape[0]
    width = max(float(np.median(values[:, -1] - values[:, 0])) / 16, 1e-12)
    starts = np.stack([np.searchsorted(values[j], hashed[:, j]) for j in range(m)], 1)
    squares = np.einsum("ij,ij->i", x, x)
    out = []
    for i in range(len(q)):
        hits = np.zeros(n, np.int64)
        low, high = starts[i].copy(), starts[i].copy()
        waiting = ids != query_ids[i]
        rows, distances = np.zeros(0, np.int64), np.zeros(0)
        half = width
        while True:
            new_low = [int(np.searchsorted(values[j], hashed[i, j] - half, "left")) for j in range(m)]
            new_high = [int(np.searchsorted(values[j], hashed[i, j] + half, "right")) for j in range(m)]
            hits += np.bincount(np.concatenate([order[j, a:b] for j in range(m) for a, b in ((new_low[j], low[j]), (high[j], new_high[j]))]), minlength=n)
            low, high = np.minimum(low, new_low), np.maximum(high, new_high)
            everything = bool((low == 0).all() and (high == n).all())
            fresh = np.flatnonzero(waiting if everything else (hits >= threshold) & waiting)
            if len(fresh):
                waiting[fresh] = False
                near = squares[fresh] - 2.0 * (x[fresh] @ q[i])  # the squared distance but for the query's own square
                if len(fresh) > k:  # what is surely not among the k nearest needs no exact distance
                    slack = 1e-9 * (1.0 + squares[fresh].max() + q[i] @ q[i])
                    fresh = fresh[near <= np.partition(near, k - 1)[k - 1] + slack]
                rows = np.concatenate((rows, fresh))
                distances = np.concatenate((distances, np.sqrt(((x[fresh] - q[i]) ** 2).sum(1))))
                best = np.lexsort((ids[rows], distances))[:k]
                rows, distances = rows[best], distances[best]
            if everything or len(rows) == k and distances[-1] <= trust * half:
                break
            half *= ratio
        out.append((np.full(len(rows), i), rows, distances))
    return tuple(np.concatenate(parts) for parts in zip(*out)) if out else (np.zeros(0, int),) * 3


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 32,
            share: float = 0.5, ratio: float = 1.1, trust: float = 1.15, block_rows: int = 16384, query_rows: int = 256, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by Euclidean distance, nearest first.

    ``share``: a vector is verified after falling into the windows of that share of the projections. ``trust``: see above. Larger values of
    ``trust`` end earlier; smaller ones verify more. A query is no candidate of its own.
    """
    k_best = k
    vectors, queries = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    index = build_index(vectors, block_rows, projections, seed)
    asked = settle(queries.distinct(), "queries")
    n_groups, blocks = max(1, math.ceil(asked.count() / query_rows)), (index.agg(F.max("block")).head()[0] or 0) + 1
    groups = asked.groupBy(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_groups)).alias("group")).agg(F.collect_list(F.struct("vec_id", "vector")).alias("asked"))
    threshold = max(1, math.ceil(share * projections))
    copies = max(1, min(n_groups, math.ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / blocks)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    parts = ("ids", "vectors", "values", "order")
    held = index.select("block", numbers(copies).alias("copy"), F.lit(-1).cast("long").alias("group"), *parts, none("asked", "array<struct<vec_id:bigint,vector:array<double>>>"))
    sent = groups.select(numbers(blocks).alias("block"), F.pmod("group", F.lit(copies)).cast("long").alias("copy"), F.col("group").cast("long").alias("group"), *[none(x, "binary") for x in parts], "asked")
    # A block comes first, then its groups of queries, one at a time.
    lined = held.unionByName(sent).repartition(blocks * copies, "block", "copy").sortWithinPartitions("block", "copy", "group")

    def work(batches):
        ids = x = values = order = hashes = block = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in (*parts, "block", "group", "asked")}
                if row["group"].as_py() < 0:
                    block = row["block"].as_py()
                    ids = np.frombuffer(row["ids"].as_py(), np.int64)
                    x = np.frombuffer(row["vectors"].as_py()).reshape(len(ids), -1)
                    values = np.frombuffer(row["values"].as_py()).reshape(projections, -1)
                    order = np.frombuffer(row["order"].as_py(), np.int32).reshape(projections, -1)
                    hashes = directions(x.shape[1], projections, seed)
                    continue
                found = row["asked"].as_py()
                query_ids = np.array([a["vec_id"] for a in found], np.int64)
                q = np.array([a["vector"] for a in found])
                if row["block"].as_py() != block or q.shape[1] != x.shape[1]:  # no such block, or other dimensions
                    continue
                who, near, distances = search_block(ids, x, values, order, query_ids, q, q @ hashes, k_best, threshold, ratio, trust)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(ids[near]), pa.array(distances)], ["query_id", "vec_id", "score"])

    found = lined.mapInArrow(work, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k_best).select("query_id", "rank", "vec_id", "score")
