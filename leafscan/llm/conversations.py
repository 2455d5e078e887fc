"""Repair of the turn structure of conversations by an auction shortest-path algorithm.

A conversation is a lattice: a node for each place between rows and each state of the role grammar ``(s?(ua)+)?``, an arc for each edit with an
integer cost. The auction (``auction``) holds a price for each node and one path from the start: the end of the path is extended along its cheapest
arc, or its price is raised to what its arcs offer and the path is contracted. Prices stay dual feasible (price <= cost + price of the arc's head), so
when the path arrives, the price difference is the least cost and every cheapest path runs over tight arcs only. ``least`` walks those arcs in the
order of their labels.

Long conversations: rows are put in one global order (``ordering``), and a conversation is cut into pieces where that order passes a multiple of
``PIECE`` rows. A piece becomes 4 x 4 arcs (cost from each state to each state, and the rank of its least edits among those with the same start),
``PIECE`` pieces become one arc table again, and so on until a conversation is one lattice; going down, each piece learns where it starts and ends. Edit
strings of a piece end with the edit of its last row and none is the beginning of another, so ranks decide as the whole strings would. No task holds
more than ``PIECE`` rows or pieces of a conversation. The repaired text is a SHA-256 of the whole conversation, which can only be computed in order:
its rows pass through one task as a stream, with the conversation's edit string (a column of the result) and nothing else in memory.

Defined results: nulls in ``conv_id`` and ``turn`` count as one space in the damage's key, null roles and texts as one space throughout; a null
``conv_id`` is a conversation, null turns come first. Rows of one turn are ordered by role, the first 16 characters and the MD5 of their text; equal rows
are interchangeable. Roles count by their first character; an empty or other role can only be changed or deleted. A conversation without rows after
damage gives zeros, an empty audit and the digest of the empty string. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafscan.llm import common as c, ordering
from leafscan.session import settle

# --- Fixed values: edits, their costs, faults and the role grammar -------------------------------
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
FINE, TRUNCATED, BLANK, DUPLICATE = 0, 1, 2, 3
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = (USER, USER, ASSISTANT, USER)  # the state that a changed or inserted role leads to
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
# --- End of fixed values -------------------------------------------------------------------------
STATES = range(4)
PIECE = 64  # rows in a piece, pieces in a piece of the next round
INITIALS = "sua"  # any other first character is one kind

Lattice = list[list[tuple]]  # arcs of each node: (label, cost, head), labels ascending; the last node is the goal


def auction(arcs: Lattice, prices: list, start: int, goal: int):
    """Least cost from ``start`` to ``goal`` (infinite if there is no path); ``prices``, dual feasible, are raised in place.

    Every node either reaches the goal or is in no cycle, and cycles cost more than 0.
    """
    path = [start]
    while (at := path[-1]) != goal:
        best, head = math.inf, None
        for _, cost, to in arcs[at]:
            if cost + prices[to] < best:
                best, head = cost + prices[to], to
        if prices[at] < best:
            prices[at] = best
            if len(path) > 1:
                path.pop()
            elif best == math.inf:
                return math.inf
        else:
            path.append(head)
    return prices[start] - prices[goal]


def least(arcs: Lattice, prices: list, start: int, goal: int) -> tuple[list, list[int]]:
    """Labels and nodes of the first path over tight arcs in the order of labels, after ``auction``."""
    path, turns, dead = [start], [0], set()
    while (at := path[-1]) != goal:
        for k in range(turns[-1], len(arcs[at])):
            _, cost, to = arcs[at][k]
            if to not in dead and prices[at] == cost + prices[to]:
                turns[-1] = k + 1
                path.append(to)
                turns.append(0)
                break
        else:
            dead.add(at)
            path.pop()
            turns.pop()
    return [arcs[at][k - 1][0] for at, k in zip(path, turns[:-1])], path


def symbol(initial: str, fault: int) -> str:
    """One letter for what the edits of a row depend on."""
    return chr(97 + 3 * (INITIALS.find(initial) if initial in INITIALS and initial else 3) + min(fault, BLANK))


def _row_arcs(sign: str, state: int, below: int) -> list[tuple]:
    """Arcs over one row to the nodes of the place after it, which begin at ``below``."""
    initial, fault = (*INITIALS, "")[(ord(sign) - 97) // 3], (ord(sign) - 97) % 3
    arcs = [(DELETE, DELETE_COST, below + state)]
    if fault != BLANK:
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if (state, initial) in KEPT:
            arcs.append((KEEP, more, below + KEPT[state, initial]))
        arcs.append((REROLE, REROLE_COST + more, below + FORCED[state]))
    return arcs


def _row_floor(sign: str) -> int:
    """The least any edit of this row costs."""
    initial, fault = (ord(sign) - 97) // 3, (ord(sign) - 97) % 3
    return DELETE_COST if fault == BLANK else min(DELETE_COST, fault + (REROLE_COST if initial == 3 else 0))


def rows_lattice(signs: str) -> tuple[Lattice, list[int]]:
    """Arcs over the rows of ``signs`` with insertions before each of them, and feasible prices: what the rows left cost at least."""
    arcs: Lattice = []
    for i, sign in enumerate(signs):
        for state in STATES:
            over = _row_arcs(sign, state, 4 * i + 4)
            arcs.append([over[0], (INSERT, INSERT_COST, 4 * i + FORCED[state]), *over[1:]])
    prices = [0] * 4
    for sign in reversed(signs):
        prices = [_row_floor(sign) + prices[0]] * 4 + prices
    return arcs, prices


def pieces_lattice(tables: list[list[int]]) -> tuple[Lattice, list[int]]:
    """Arcs over pieces, whose tables hold 16 costs (-1: no way) and 16 ranks; labels are the ranks."""
    arcs: Lattice = []
    for i, table in enumerate(tables):
        for state in STATES:
            arcs.append(sorted((table[16 + 4 * state + to], table[4 * state + to], 4 * i + 4 + to) for to in STATES if table[4 * state + to] >= 0))
    prices = [0] * 4
    for table in reversed(tables):
        prices = [min(x for x in table[:16] if x >= 0) + prices[0]] * 4 + prices
    return arcs, prices


def finished(arcs: Lattice, prices: list[int]) -> tuple[Lattice, list[int], int]:
    """The lattice of a whole conversation: insertions behind the last row, and a goal behind the states that may end it."""
    last, goal = len(arcs), len(arcs) + 4
    ends = [[(INSERT, INSERT_COST, last + FORCED[state])] for state in STATES]
    for state in (START, ASSISTANT):
        ends[state].insert(0, ("", 0, goal))
    return [*arcs, *ends, []], [*prices, 0], goal


def between(arcs: Lattice, prices: list[int], to: int) -> tuple[Lattice, list, int]:
    """The lattice of a piece that ends in state ``to``: only nodes from which that state can be reached at all."""
    goal = len(arcs) + to
    reach = set(STATES) if to in (USER, ASSISTANT) else set(range(to + 1))
    kept = [[a for a in row if a[2] % 4 in reach] if i % 4 in reach else [] for i, row in enumerate(arcs)]
    return [*kept, *([] for _ in STATES)], list(prices), goal


def contracted(arcs: Lattice, prices: list[int]) -> list[int]:
    """Table of a piece: least cost from each state to each state, and the rank of its least labels among those with the same start."""
    costs, ranks = [-1] * 16, [0] * 16
    found: list[list[tuple]] = [[] for _ in STATES]
    for to in STATES:
        own, own_prices, goal = between(arcs, prices, to)
        for state in STATES:
            cost = auction(own, own_prices, state, goal)
            if cost != math.inf:
                costs[4 * state + to] = cost
                found[state].append((least(own, own_prices, state, goal)[0], to))
    for state in STATES:
        for rank, (_, to) in enumerate(sorted(found[state])):
            ranks[4 * state + to] = rank
    return costs + ranks


@lru_cache(1 << 14)
def solve(signs: str) -> tuple[int, str]:
    """Least cost and least edit string of a whole conversation."""
    arcs, prices, goal = finished(*rows_lattice(signs))
    cost = auction(arcs, prices, START, goal)
    return cost, "".join(least(arcs, prices, START, goal)[0])


@lru_cache(1 << 12)
def table_of(signs: str) -> tuple[int, ...]:
    return tuple(contracted(*rows_lattice(signs)))


@lru_cache(1 << 12)
def edits_between(signs: str, state: int, to: int) -> str:
    """Least edit string of a piece with a given start and end."""
    arcs, prices, goal = between(*rows_lattice(signs), to)
    auction(arcs, prices, state, goal)
    return "".join(least(arcs, prices, state, goal)[0])


# --- Rows -------------------------------------------------------------------------------------------

def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows (key, turn, role, text) after the damage that the crc32 of ``conv_id:turn`` decides."""
    blank = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    conv, turn = F.col(f"`{id_col}`"), F.col(f"`{turn_col}`")
    kind = F.crc32(F.concat_ws(":", blank(conv), blank(turn)).cast("binary")) % 20
    text = blank(F.col("text"))
    slim = rows.select(
        ordering.key_of(conv).alias("key"), turn.cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(blank(F.col("role"))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_copies"), kind.alias("_kind"))
    return slim.filter("_kind <> 0").withColumn("_copy", F.explode("_copies")).drop("_copies", "_kind", "_copy")


def _order(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_head": F.substring("text", 1, 16), "_md5": F.md5(F.col("text").cast("binary"))})


ORDER = ["key", "turn", "role", "_head", "_md5"]


def _fault(text: Column) -> Column:
    core = F.rtrim(text, F.lit(WHITE))
    return F.when(core == "", BLANK).when(F.right(core, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


def pieces(rows: DataFrame) -> DataFrame:
    """Pieces (key, piece, signs, blank, duplicate, truncated) of the conversations. No text is moved."""
    slim = _order(rows).select(*ORDER, F.substring("role", 1, 1).alias("_initial"), _fault(F.col("text")).alias("_fault"), F.monotonically_increasing_id().alias("_row"))
    placed = settle(ordering.numbered(ordering.ordered(settle(slim, "turns"), [*ORDER, "_row"], "ordered"), "_pos"), "numbered")
    first = placed.filter(f"_fault <> {BLANK}").groupBy("key", "role", "_md5").agg(F.min("_pos").alias("_pos"))
    none = F.lit(None)
    marks = placed.select("key", "_pos", "_initial", "_fault").unionByName(first.select("key", "_pos", none.cast("string").alias("_initial"), none.cast("int").alias("_fault")))
    # A row and the mark of a first row share a place; a list holds PIECE of each at most.
    listed = marks.groupBy("key", F.floor(F.col("_pos") / PIECE).cast("long").alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_fault", F.lit(9)).alias("fault"), F.coalesce("_initial", F.lit("")).alias("initial")))).alias("rows"))
    return settle(listed.mapInArrow(_signs, "key string, piece long, signs string, blank long, duplicate long, truncated long"), "pieces")


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for rows in batch.column("rows").to_pylist():
            firsts = {r["_pos"] for r in rows if r["fault"] == 9}
            own = [(r["initial"], r["fault"] if r["fault"] == BLANK or r["_pos"] in firsts else DUPLICATE) for r in rows if r["fault"] != 9]
            faults = [f for _, f in own]
            for column, value in zip(out, ("".join(symbol(i, f) for i, f in own), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("piece"), *map(pa.array, out)], ["key", "piece", "signs", "blank", "duplicate", "truncated"])


# --- Rounds over the pieces of conversations that have more than one ---------------------------------

def _up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    tables = table.sort_by("piece")["arcs"].to_pylist()
    return pa.table({"key": [key[0].as_py()], "piece": pa.array([key[1].as_py()], pa.int64()), "arcs": pa.array([contracted(*pieces_lattice(tables))], pa.list_(pa.int64()))})


_WAYS = "key string, piece long, state int, target int, tail string, cost long"


def _ways(key: str, found: pa.Table, path: list[int], tail: str = "", cost: int | None = None) -> pa.Table:
    """One row for each piece: the state it starts and ends in; the last one carries the edits behind it and the cost of all."""
    n = found.num_rows
    states = [x % 4 for x in path[:n + 1]]
    return pa.table({"key": [key] * n, "piece": found["piece"], "state": pa.array(states[:n], pa.int32()), "target": pa.array(states[1:], pa.int32()),
                     "tail": pa.array([None] * (n - 1) + [tail], pa.string()), "cost": pa.array([None] * (n - 1) + [cost], pa.int64())})


def _finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("piece")
    arcs, prices, goal = finished(*pieces_lattice(table["arcs"].to_pylist()))
    cost = auction(arcs, prices, START, goal)
    labels, path = least(arcs, prices, START, goal)
    return _ways(key[0].as_py(), table, path, "".join(x for x in labels if isinstance(x, str)), cost)


def _down(above: pa.Table, table: pa.Table) -> pa.Table:
    table = table.sort_by("piece")
    row = above.to_pylist()[0]
    arcs, prices, goal = between(*pieces_lattice(table["arcs"].to_pylist()), row["target"])
    auction(arcs, prices, row["state"], goal)
    return _ways(row["key"], table, least(arcs, prices, row["state"], goal)[1], row["tail"], row["cost"])


def _grouped(parts: DataFrame) -> DataFrame:
    return parts.withColumn("_up", F.floor(F.col("piece") / PIECE).cast("long"))


def ways(many: DataFrame) -> DataFrame:
    """Start and end state of each piece (key, piece, arcs) of conversations with more than one."""
    levels, solved = [many], []
    while True:
        parts = _grouped(levels[-1])
        groups = settle(parts.groupBy("key", "_up").agg(F.count(F.lit(1)).alias("_n")).groupBy("key").agg(F.count(F.lit(1)).alias("_groups")), "groups")
        whole, split = groups.filter("_groups = 1").select("key"), groups.filter("_groups > 1").select("key")
        solved.append(settle(parts.join(whole, "key").groupBy("key").applyInArrow(_finish, _WAYS), "solved"))
        if split.isEmpty():
            break
        levels.append(settle(parts.join(split, "key").select("key", "_up", "piece", "arcs").groupBy("key", "_up").applyInArrow(_up, "key string, piece long, arcs array<long>"), "level"))
    found = solved.pop()
    for level in reversed(levels[:-1]):
        above = found.withColumnRenamed("piece", "_up")
        below = _grouped(level).join(above.select("key").distinct(), "key")
        down = above.groupBy("key", "_up").cogroup(below.groupBy("key", "_up")).applyInArrow(_down, _WAYS)
        found = settle(down.unionByName(solved.pop()), "ways")
    return found


def _one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [solve(x) for x in batch["signs"]]
        yield pd.DataFrame({"key": batch["key"], "cost": [x[0] for x in found], "audit": [x[1] for x in found]})


def _arcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "piece": batch["piece"], "arcs": [list(table_of(x)) for x in batch["signs"]]})


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        edits = [edits_between(*x) for x in zip(batch["signs"], batch["state"].astype(int), batch["target"].astype(int))]
        yield batch[["key", "piece", "tail", "cost"]].assign(edits=edits)


def audits(parts: DataFrame) -> DataFrame:
    """Cost and edit string of each conversation (key, cost, audit) from its pieces."""
    counts = parts.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    # Conversations of one piece need no other row; which ones have more is a far smaller table.
    many = settle(counts.filter("_n > 1").select("key"), "many")
    single = parts.join(many, "key", "left_anti").mapInPandas(_one, "key string, cost long, audit string")
    long = settle(parts.join(many, "key").select("key", "piece", "signs"), "long")
    if long.isEmpty():
        return single
    spans = ways(settle(long.mapInPandas(_arcs, "key string, piece long, arcs array<long>"), "arcs"))
    own = long.join(spans, ["key", "piece"]).mapInPandas(_edits, "key string, piece long, tail string, cost double, edits string")
    joined = own.groupBy("key").agg(F.max("cost").cast("long").alias("cost"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("piece", F.concat("edits", F.coalesce("tail", F.lit(""))).alias("edits")))), lambda x: x["edits"]), "").alias("audit"))
    return single.unionByName(joined)


# --- The repaired text ------------------------------------------------------------------------------

class _Repair:
    """One conversation as a stream: its edit string, then its rows in order."""

    def __init__(self, row: dict):
        self.row, self.digest, self.at, self.state, self.empty = row, hashlib.sha256(), 0, START, True
        self.initial, self.illegal, self.turns, self.low, self.high = None, 0, 0, None, None

    def _say(self, role: str, text: str) -> None:
        self.digest.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty = False

    def _inserts(self) -> None:
        audit = self.row["audit"]
        while self.at < len(audit) and audit[self.at] == INSERT:
            self.state = FORCED[self.state]
            self._say(NAMES[self.state], "")
            self.at += 1

    def push(self, turn: int | None, role: str, text: str) -> None:
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self._inserts()
        edit = self.row["audit"][self.at]
        self.at += 1
        if edit == KEEP:
            self.state = KEPT[self.state, initial]
            self._say(role, text)
        elif edit == REROLE:
            self.state = FORCED[self.state]
            self._say(NAMES[self.state], text)

    def result(self) -> tuple:
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        r = self.row
        return r["key"], gaps, r["blank"], r["duplicate"], r["truncated"], self.illegal, r["cost"], r["audit"], self.digest.hexdigest()


_RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
_TYPES = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: _Repair | None = None
    for whole in batches:
        for batch in c.slices(iter((whole,)), "text"):
            done = []
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if current is not None:
                        done.append(current.result())
                    current = _Repair(row)
                else:
                    current.push(row["turn"], row["role"], row["text"])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), _TYPES)], _NAMES)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(current.result(), _TYPES)], _NAMES)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of each conversation, after the damage."""
    after = damaged(rows, id_col, turn_col)
    parts = pieces(after)
    faults = parts.groupBy("key").agg(*[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    heads = audits(parts).join(faults, "key")
    # Conversations that have lost all rows: their keys are few enough to be found by an anti join of distinct keys.
    lost = rows.select(ordering.key_of(F.col(f"`{id_col}`")).alias("key")).distinct().join(faults.select("key"), "key", "left_anti")
    zero = lost.select("key", *[F.lit(0).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "cost")], F.lit("").alias("audit"))
    texts = _order(after).select(*ORDER, "text", F.lit(1).alias("_kind"))
    stream = heads.unionByName(zero).withColumn("_kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    parts_of = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = stream.repartition(parts_of, "key").sortWithinPartitions("key", "_kind", *ORDER[1:]).select("key", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "blank", "duplicate", "truncated", "cost", "audit")
    out = lined.mapInArrow(_repaired, _RESULT)
    number = F.when(F.col("key") != "-", F.expr("substring(key, 2)")).cast("long").alias("conv_id")
    return out.select(number, *_NAMES[1:])
