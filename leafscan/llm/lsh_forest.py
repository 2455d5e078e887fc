"""Near-duplicate join: MinHash LSH forest over word n-grams, exact verification, classes and link counts.

1. Equal texts are one representative (smallest id). Its signature is cut into ``trees`` runs of ``longest`` labels; texts sorted by the labels of a
   run are a prefix trie.
2. Each trie is walked from its longest shared prefixes to shorter ones, down to ``depth``: the longest prefix at which a pair at the threshold is found
   in some tree with the target recall, ``1 - (1 - t^depth)^trees`` (6 labels, then 5, then 4). Texts that share a prefix are compared by their whole signatures, and
   those that may reach the threshold (``slack`` standard errors) are connected. A shorter prefix compares only what longer ones have not connected, so
   the walk of a subtree ends as soon as its texts hang together: groups of near copies never come to the short prefixes. Subtrees below the
   prefixes of length ``depth`` are spread over tasks ("node" below); each leaves fewer edges than it has texts.
3. Edges are joined to components by alternating stars. The texts of a component are verified exactly, all against all in numpy matrices of
   their n-gram sets: each text gets its number of links, each component the spanning edges of its true links. True links make the classes.

Nodes and components above ``node_rows`` and ``block_rows`` are dealt into blocks by a hash, and each pair of blocks is a task, so neither a large group of
near copies nor a common passage meets in one task, no pair of texts is written as a row, and no link is lost to a cap.

Words are ``[^\\x20\\x09-\\x0D]+`` in lower case; a text of fewer than ``n`` words is one gram of all its words. Null texts are empty. Texts without words are
alike only if equal. Null ids come after all others as representatives; rows that repeat are copies. Empty tables give empty results; other columns are
not looked at. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from leafscan.llm import common as c
from leafscan.session import settle

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)  # fixed odd multipliers


@dataclass(frozen=True)
class Forest:
    n: int = 5
    threshold: float = 0.8
    trees: int = 20
    longest: int = 6
    recall: float = 0.9999
    slack: float = 4.5
    node_rows: int = 1024
    block_rows: int = 256

    @property
    def hashes(self) -> int:
        return self.trees * self.longest

    @property
    def depth(self) -> int:
        """The longest prefix that reaches the target recall."""
        depth = self.longest
        while depth > 1 and 1 - (1 - self.threshold ** depth) ** self.trees < self.recall:
            depth -= 1
        return depth

    @property
    def least(self) -> float:
        """Smallest share of equal signature values that a pair at the threshold may have."""
        return self.threshold - self.slack * math.sqrt(self.threshold * (1 - self.threshold) / self.hashes)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 64-bit hashes) of the word n-grams of each text, in the order of the text."""
    at, words = c.words_of(pc.utf8_lower(texts))
    encoded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
    h = known[encoded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    counts = np.diff(at)
    with np.errstate(over="ignore"):
        rolled = h * _ODD[0]
        for k in range(1, n):
            rolled[:len(h) - k] += _mix(h[k:]) * (_ODD[k % len(_ODD)] + np.uint64(2 * k))
        short = np.flatnonzero((counts > 0) & (counts < n))
        keep = np.zeros(len(h), bool)
        owner = c.owners(at)
        if len(h) >= n:
            keep[:len(h) - n + 1] = owner[n - 1:] == owner[:len(h) - n + 1]
        for k in short:
            value = np.uint64(counts[k])
            for x in h[at[k]:at[k + 1]]:
                value = _mix(value * _ODD[0] + x)
            rolled[at[k]], keep[at[k]] = value, True
        rolled = _mix(rolled)
    return np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[at], rolled[keep]


def signatures(offsets: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (16 bits of each) of the lists that are not empty, one row each."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(starts), size), np.uint16)
    if len(starts):
        low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
        salts = np.random.default_rng(11).integers(1, 1 << 32, (size, 2), dtype=np.uint32)
        mixed = np.empty_like(low)
        for k, (a, b) in enumerate(salts):
            np.bitwise_xor(low, b, out=mixed)
            np.multiply(mixed, a | np.uint32(1), out=mixed)
            least = np.minimum.reduceat(mixed, starts)
            out[:, k] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def _sign(rows: DataFrame, f: Forest) -> DataFrame:
    """Settled (_row, doc_id, _a, _b, _n, _signature): the text's 128-bit hash, its number of n-grams and its signature."""
    def work(batches):
        for batch in c.slices(batches, "text", c.SLICE_BYTES // 4):
            texts = batch.column("text")
            offsets, values = grams(texts, f.n)
            n = np.diff(offsets)
            signed = iter(signatures(offsets, values, f.hashes))
            digests = [xxhash.xxh3_128_intdigest(t) for t in texts.to_pylist()]
            as_long = lambda x: x - (1 << 64) if x >= 1 << 63 else x
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), batch.column("doc_id"), pa.array([as_long(d >> 64) for d in digests], pa.int64()),
                pa.array([as_long(d & (1 << 64) - 1) for d in digests], pa.int64()), pa.array(n), pa.array([next(signed).tobytes() if k else b"" for k in n], pa.binary())],
                ["_row", "doc_id", "_a", "_b", "_n", "_signature"])
            c.give_back()

    return settle(rows.mapInArrow(work, "_row long, doc_id long, _a long, _b long, _n long, _signature binary"), "signed")


def _nodes(texts: DataFrame, f: Forest) -> DataFrame:
    """(node, tree, rep): the subtree below its first ``depth`` labels that a representative lies in, for each tree."""
    def work(batches):
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column("_signature").to_pylist()), np.uint16).reshape(-1, f.trees, f.longest)[:, :, :f.depth].astype(np.uint64)
            node = np.broadcast_to(np.arange(1, f.trees + 1, dtype=np.uint64), s.shape[:2]) * _ODD[1]
            with np.errstate(over="ignore"):
                for k in range(f.depth):
                    node = _mix(node * _ODD[0] + s[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(list(node.view(np.int64)), pa.list_(pa.int64())), batch.column("rep")], ["nodes", "rep"])

    listed = texts.select("rep", "_signature").mapInArrow(work, "nodes array<long>, rep long")
    return listed.select(F.posexplode("nodes").alias("tree", "node"), "rep")


def dealt(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Rows of a group of ``size`` rows, once for each pair of blocks (_i, _j) that their block _block belongs to; a small group is one block."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_other")


class _Sets:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def walk(s: np.ndarray, labels: np.ndarray, depth: int, least: float) -> tuple[list[tuple[int, int]], int]:
    """(spanning edges, length of the shortest prefix that was needed) of texts with signatures ``s`` and the trie of their ``labels``.

    Two texts are connected exactly if a chain of pairs, each of which may reach the threshold, leads from one to the other.
    """
    order = np.lexsort(labels.T[::-1])
    s, labels = s[order], labels[order]
    edges, group, used = [], np.arange(len(s)), labels.shape[1]
    for length in range(labels.shape[1], depth - 1, -1):
        if (group == group[0]).all():
            break
        used = length
        starts = np.flatnonzero(np.concatenate(([True], (labels[1:, :length] != labels[:-1, :length]).any(1))))
        for a, b in zip(starts, [*starts[1:], len(s)]):
            for p in range(a, b - 1):
                apart = p + 1 + np.flatnonzero(group[p + 1:b] != group[p])
                if len(apart):
                    for x in apart[(s[apart] == s[p]).mean(1) >= least]:
                        if group[x] != group[p]:
                            group[group == group[x]] = group[p]
                            edges.append((int(order[p]), int(order[x])))
    return edges, used


def candidate_edges(texts: DataFrame, f: Forest) -> DataFrame:
    """(a, b): spanning edges of what may be near duplicates, over all nodes of all trees."""
    nodes = _nodes(texts, f)
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    rows = nodes.join(shared, "node").join(texts.select("rep", "_signature"), "rep")
    least = f.least

    def work(batches):
        found = []
        for group in c.groups(batches, ["node", "_i", "_j"]):
            reps = group.column("rep").to_numpy()
            s = np.frombuffer(b"".join(group.column("_signature").to_pylist()), np.uint16).reshape(len(reps), -1)
            tree = group.column("tree")[0].as_py()
            edges, _ = walk(s, s[:, tree * f.longest:(tree + 1) * f.longest], f.depth, least)
            found += [(int(reps[x]), int(reps[y])) for x, y in edges]
            if len(found) > 10_000:
                yield pairs_of(found)
                found = []
        yield pairs_of(found)

    def pairs_of(found):
        return pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], ["a", "b"])

    keys = ["node", "_i", "_j"]
    grouped = dealt(rows, "_size", f.node_rows).select(*keys, "tree", "rep", "_signature").repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(rep, root) of every end of the edges (a > b): the smallest end that it is connected with. Alternating large and small stars."""
    state, edges = None, settle(edges, "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = settle(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a > b").distinct(), "edges")
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            roots = edges.select(F.col("a").alias("rep"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("rep"), "root").distinct())
        state = found


def _links(sets: list[np.ndarray], side: np.ndarray, same_block: bool, threshold: float) -> np.ndarray:
    """Matrix of the pairs of n-gram sets that reach the threshold; of two blocks only the pairs across."""
    sizes = np.array([len(x) for x in sets])
    codes, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
    owner, both, step = owner[shared], np.zeros((len(sets), len(sets)), np.float64), 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (start, start + step))
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        both += part @ part.T
    link = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(link, False)
    return link if same_block else link & (side[:, None] != side[None, :])


def verified(rows: DataFrame, members: DataFrame, f: Forest) -> DataFrame:
    """Settled (a, b, n): spanning edges of the true links (n null) and link counts of texts (b null). ``members``: (rep, root, _size)."""
    def sets_of(batches):
        for batch in c.slices(batches, "text", c.SLICE_BYTES // 4):
            offsets, values = grams(batch.column("text"), f.n)
            sets = [np.unique(values[a:b]).tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("root"), batch.column("_size"), pa.array(sets, pa.binary())], ["rep", "root", "_size", "_set"])
            c.give_back()

    # A merge join at every size: members grow with the corpus, so their broadcast would only hold for small ones.
    texts = rows.select(F.col("_row").alias("rep"), "text").join(members.hint("merge"), "rep").select("rep", "root", "_size", "text")
    listed = texts.mapInArrow(sets_of, "rep long, root long, _size long, _set binary")
    keys = ["root", "_i", "_j"]
    grouped = dealt(listed, "_size", f.block_rows).select(*keys, "_block", "rep", "_set").repartition(*keys).sortWithinPartitions(*keys)

    def work(batches):
        for group in c.groups(batches, keys):
            reps, side = group.column("rep").to_numpy(), group.column("_block").to_numpy()
            link = _links([np.frombuffer(x, np.uint64) for x in group.column("_set").to_pylist()], side,
                          group.column("_i")[0].as_py() == group.column("_j")[0].as_py(), f.threshold)
            joined, edges = _Sets(len(reps)), []
            for x, y in np.argwhere(np.triu(link)).tolist():
                if joined.join(x, y):
                    edges.append((max(reps[x], reps[y]), min(reps[x], reps[y])))
            n = link.sum(1)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([e[0] for e in edges] + reps[some].tolist(), pa.int64()), pa.array([e[1] for e in edges] + [None] * len(some), pa.int64()),
                pa.array([None] * len(edges) + n[some].tolist(), pa.int64())], ["a", "b", "n"])

    return settle(grouped.mapInArrow(work, "a long, b long, n long"), "verified")


def _order(id_col: str):
    return F.struct(F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("doc_id"), F.col("_row"))


def classes(rows: DataFrame, f: Forest = Forest()) -> DataFrame:
    """(_row, doc_id, class_id, n_links, n_copies, kept) of settled rows (_row, doc_id, text); ``kept`` marks one row of each class."""
    signed = _sign(rows, f)
    texts = settle(signed.groupBy("_a", "_b").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row", "_n", "_signature")).alias("_first"), F.count(F.lit(1)).alias("n_copies"))
        .select("_a", "_b", "n_copies", F.col("_first._row").alias("rep"), F.col("_first.doc_id").alias("rep_id"), F.col("_first._n").alias("_n"), F.col("_first._signature").alias("_signature")), "texts")
    roots = components(candidate_edges(texts.filter("_n > 0"), f))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    true = verified(rows, roots.join(sizes, "root").select("rep", "root", "_size"), f)
    links = true.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    known = (texts.select("_a", "_b", "rep", "rep_id", "n_copies").join(links, "rep", "left")
             .join(components(true.filter("b IS NOT NULL").select("a", "b")), "rep", "left")
             .withColumn("root", F.coalesce("root", "rep")))
    known = settle(known, "known")
    heads = known.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("_none"), F.col("rep_id").alias("doc_id"), F.col("rep").alias("_row"))).alias("_head"))
    known = known.join(heads, "root").select("_a", "_b", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies",
                                             F.col("_head.doc_id").alias("class_id"), F.col("_head._row").alias("_kept"))
    return signed.select("_row", "doc_id", "_a", "_b").join(known, ["_a", "_b"]).select(
        "_row", "doc_id", "class_id", "n_links", "n_copies", (F.col("_row") == F.col("_kept")).alias("kept"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return settle(docs.select(F.monotonically_increasing_id().alias("_row"), c.row_id(id_col).alias("doc_id"), c.text_of(text_col).alias("text")), "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies): class and links of every document. ``class_id`` is the smallest id of the class, ``n_links`` the
    number of other texts that reach the threshold, ``n_copies`` the number of documents with the same text."""
    return classes(_numbered(docs, id_col, text_col), forest).drop("_row", "kept")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """The documents that are the first of their class, with all their columns as they were."""
    names, key = docs.columns, c.fresh(docs, "_row")
    whole = settle(docs.select("*", F.monotonically_increasing_id().alias(key)), "rows")
    rows = whole.select(F.col(key).alias("_row"), c.row_id(id_col).alias("doc_id"), c.text_of(text_col).alias("text"))
    kept = classes(rows, forest).filter("kept").select(F.col("_row").alias(key))
    return whole.join(kept, key, "left_semi").select(*[F.col(f"`{n}`") for n in names])
