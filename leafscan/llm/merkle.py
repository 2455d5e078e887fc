"""Merkle manifest of a dataset: a tree of SHA-256 digests for each partition value (``lang``), and one over their roots.

A leaf is the digest of a row's fields, made by Spark functions in the scan, so no text is moved. Every ``fanout`` consecutive nodes have a parent,
the digest of their hexadecimal digests. A parent keeps a copy of its hash state before each child slot (``Parent.states``). Folding a changed leaf
up its path takes the state before the leaf's slot and feeds only the replacement and the siblings to its right.

How it runs: leaves are sorted by range partitions and numbered by prefix sums (``ordering``). ``fanout ** levels`` consecutive nodes are one chunk,
so a task holds at most that many; chunks give the nodes of the next round until each tree has one. Going down, each chunk is built again from its
nodes and meets the one path of its top (cogroup); the states along that path are made once for the chunk and resumed for each of its rows.
A tree with a third of all rows is as many chunks as it needs; only chunk tops (1 in 256) travel between rounds.

Defined results: a null field is ``-``; a null ``doc_id`` sorts first and is never tampered with; a null partition value is a tree of its own, before all others. Repeated
``doc_id`` are ordered by their leaf; equal rows are equal leaves side by side. Empty texts are fields of 0 bytes. An empty table gives no rows.
Other columns are not looked at. Rows are settled before they are ordered, so a lost executor changes no place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafscan.llm import common as c, ordering
from leafscan.session import settle

FANOUT, LEVELS = 2, 8
TREE, ROOTS = "_tree", "*"  # a tree's key begins with "=" or "-"; ROOTS is the key of the tree over the subroots
STEPS = "array<struct<left:array<string>,right:array<string>>>"


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of all fields, each as its UTF-8 byte count, ``:`` and value, or ``-`` if null."""
    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


class Parent:
    """A node over ``children``: its hash state before each child slot, and its digest."""

    def __init__(self, children: Sequence[str]):
        state, self.states, self.children = hashlib.sha256(), [], children
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        return resume(self.states[slot], replacement, self.children[slot + 1:])


def resume(state, replacement: str, right: Sequence[str]) -> str:
    """The digest of a parent from its state before a slot, that slot's new digest and the siblings to the right of it."""
    state = state.copy()
    state.update(replacement.encode())
    for sibling in right:
        state.update(sibling.encode())
    return state.hexdigest()


def build(nodes: Sequence[str], whole: bool, fanout: int, levels: int) -> list[list[Parent]]:
    """Rows of parents over ``nodes``: up to one node for a ``whole`` tree, else exactly ``levels`` rows, as other chunks stand beside it."""
    rows: list[list[Parent]] = []
    while len(nodes) > 1 if whole else len(rows) < levels:
        rows.append([Parent(nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)])
        nodes = [p.digest for p in rows[-1]]
    return rows


def path_in(rows: list[list[Parent]], at: int, fanout: int) -> list[tuple[Parent, int]]:
    """(parent, slot) at each row above the node in place ``at``."""
    path = []
    for row in rows:
        path.append((row[at // fanout], at % fanout))
        at //= fanout
    return path


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("_idx")


def _rise(fanout: int, levels: int):
    """Chunk of nodes to its top."""
    span = fanout ** levels

    def rise(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = _sorted(table)
        count = table["_count"][0].as_py()
        nodes = table["_node"].to_pylist()
        rows = build(nodes, count <= span, fanout, levels)
        top = rows[-1][0].digest if rows else nodes[0]
        return pa.table({TREE: [key[0].as_py()], "_idx": pa.array([key[1].as_py()], pa.int64()), "_count": pa.array([-(-count // span)], pa.int64()), "_node": [top]})

    return rise


def _chunked(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("_chunk", F.floor(F.col("_idx") / span).cast("long"))


def rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Settled tables (tree, idx, count, node) from the given nodes up to one row for each tree."""
    span, found = fanout ** levels, [nodes]
    while (nodes.agg(F.max("_count")).head() or [None])[0] not in (None, 1):
        schema = f"{TREE} string, _idx long, _count long, _node string"
        nodes = settle(_chunked(nodes, span).select(TREE, "_chunk", "_idx", "_count", "_node").groupBy(TREE, "_chunk").applyInArrow(_rise(fanout, levels), schema), "nodes")
        found.append(nodes)
    return found


def _descend(fanout: int, levels: int):
    """Chunk of nodes and the path of its top, to the path of each node."""
    span = fanout ** levels

    def descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = _sorted(nodes)
        digests = nodes["_node"].to_pylist()
        rows = build(digests, nodes["_count"][0].as_py() <= span, fanout, levels)
        upper = above["_steps"][0].as_py()
        steps = [[*({"left": list(p.children[:slot]), "right": list(p.children[slot + 1:])} for p, slot in path_in(rows, k, fanout)), *upper] for k in range(len(digests))]
        kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
        return pa.table({TREE: nodes[TREE].cast(pa.string()), "_idx": nodes["_idx"].cast(pa.int64()), "_node": nodes["_node"].cast(pa.string()), "_steps": pa.array(steps, kind)})

    return descend


def _prove(fanout: int, levels: int):
    """Chunk of leaves and the path of its top, to digest of the proof and the folded root of each leaf."""
    span = fanout ** levels

    def prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves = _sorted(leaves)
        digests, changed = leaves["_node"].to_pylist(), leaves["_changed"].to_pylist()
        rows = build(digests, leaves["_count"][0].as_py() <= span, fanout, levels)
        upper = above["_steps"][0].as_py()
        ends = "".join(x for step in upper for x in (*step["left"], *step["right"])).encode()
        kept = [(Parent([*step["left"], ""]).states[-1], step["right"]) for step in upper]
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        proofs, folded = [], []
        for at, leaf in enumerate(digests):
            proof, node = hashlib.sha256(), changed[at] or leaf
            for parent, slot in path_in(rows, at, fanout):
                for k, sibling in enumerate(parent.children):
                    if k != slot:
                        proof.update(sibling.encode())
                node = parent.fold(slot, node)
            proof.update(ends)
            for state, right in kept:
                node = resume(state, node, right)
            proofs.append(proof.hexdigest())
            folded.append(node)
        n = len(digests)
        return pa.table({"doc_id": leaves["doc_id"].cast(pa.int64()), "leaf": pa.array(digests), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n),
                         "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded])})

    return prove


def _paths(tables: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Paths of the nodes of the first of ``tables`` (rounds below the trees' single nodes), from the paths ``top`` of those nodes."""
    span = fanout ** levels
    for table in reversed(tables):
        chunks = _chunked(table, span)
        above = top.withColumnRenamed("_idx", "_chunk").select(TREE, "_chunk", "_steps")
        top = settle(chunks.groupBy(TREE, "_chunk").cogroup(above.groupBy(TREE, "_chunk")).applyInArrow(
            _descend(fanout, levels), f"{TREE} string, _idx long, _node string, _steps {STEPS}"), "paths")
    return top


class Manifest:
    """The settled tree of a table: ``leaves``, the ``rounds`` of nodes above them, ``subroots`` in order and the rounds above those."""

    def __init__(self, rows: DataFrame, leaf: Column, changed: Column, tree: Column, id_col: str, fanout: int = FANOUT, levels: int = LEVELS):
        self.fanout, self.levels = fanout, levels
        slim = settle(rows.select(ordering.key_of(tree).alias(TREE), c.row_id(id_col).alias("doc_id"), leaf.alias("_node"), changed.alias("_changed"),
                                  F.monotonically_increasing_id().alias("_row")), "leaves")
        placed = ordering.numbered(ordering.ordered(slim, [TREE, "doc_id", "_node", "_row"], "ordered"), "_idx", TREE).drop("_row")
        counts = slim.groupBy(TREE).agg(F.count(F.lit(1)).alias("_count"))
        self.few = counts.count() <= c.BROADCAST_GROUPS
        self.leaves = settle(placed.join(F.broadcast(counts) if self.few else counts, TREE), "numbered")
        self.rounds = rounds(self.leaves.select(TREE, "_idx", "_count", "_node"), fanout, levels)
        trees = self.rounds[-1].select(F.col(TREE).alias("_of"), "_node")
        ranked = ordering.numbered(ordering.ordered(settle(trees, "trees"), ["_of"], "ranked"), "_idx")
        total = ranked.count()
        self.subroots = settle(ranked.select(F.lit(ROOTS).alias(TREE), "_idx", F.lit(total).cast("long").alias("_count"), "_node", "_of"), "subroots")
        self.upper = rounds(self.subroots.select(TREE, "_idx", "_count", "_node"), fanout, levels)
        self.root = (self.upper[-1].select("_node").head() or [None])[0]

    def _tree_tops(self) -> DataFrame:
        """The path of each tree's subroot to the root."""
        end = self.upper[-1].select(TREE, "_idx", "_node", F.array().cast(STEPS).alias("_steps"))
        paths = _paths(self.upper[:-1], end, self.fanout, self.levels)
        return paths.join(self.subroots.select("_idx", "_of"), "_idx").select(F.col("_of").alias(TREE), F.lit(0).cast("long").alias("_idx"), F.col("_node").alias("subroot"), "_steps")

    def proofs(self) -> DataFrame:
        """Each leaf with the digest of its proof and the root folded from its ``changed`` digest (its own, if that is null)."""
        tops = settle(self._tree_tops(), "tops")
        roots = tops.select(TREE, "subroot")
        chunk_paths = _paths(self.rounds[1:-1], tops, self.fanout, self.levels).withColumnRenamed("_idx", "_chunk").select(TREE, "_chunk", "_steps")
        above = chunk_paths.join(F.broadcast(roots) if self.few else roots, TREE).withColumn("root", F.lit(self.root).cast("string"))
        chunks = _chunked(self.leaves, self.fanout ** self.levels)
        return chunks.groupBy(TREE, "_chunk").cogroup(above.groupBy(TREE, "_chunk")).applyInArrow(
            _prove(self.fanout, self.levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """Manifest of ``documents``; where 7 divides the crc32 of the decimal id, a changed row has one more in ``n_chars``."""
    fields = lambda n_chars: leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    n_chars = F.col("n_chars").cast("long")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return Manifest(docs, fields(n_chars), F.when(tampered & n_chars.isNotNull(), fields(n_chars + 1)), F.col("lang"), "doc_id", fanout, levels)


def verify_documents(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    return document_manifest(docs, fanout, levels).proofs()
