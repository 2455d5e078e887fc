"""Secret scan with character Markov models, in DataFrame functions only.

Three patterns give the base spans (``assign``, ``access``, ``hex``). The method adds ``markov`` spans: runs of token characters that a model of
random strings explains better than a model of ordinary identifiers. Both are first-order chains over printable ASCII, estimated from labelled
samples of all documents: what the patterns found (random) and all other runs of ``train_chars`` or more (ordinary). The random chain is mixed with a
uniform one over token characters, as a random string may be of any alphabet. A run of ``least_chars`` or more that meets no base span is
reported when its log-likelihood ratio (sum over its characters and its end) reaches ``least_ratio`` nats.

How it runs: one pass over the texts keeps, for each document and kind, the matches and the lengths of the pieces between them, and settles that
(a few percent of the texts). Transition counts are one aggregate of at most 2 x 95 x 95 rows, which is all that reaches the driver. Places are running
sums over the matches of a document; overlaps are found by a running maximum from each side, never by pairs. Documents without a match skip all
exchanges. Runs are scored in cuts of 1,000 characters, so a run of any length is no large array.

Defined results: a null or empty text has no spans and empty digest input; places count code points, ends are exclusive. Null and repeated
``doc_id`` rows are told apart by a row number and stay separate rows. Without any sample both chains are uniform and nothing is added. An empty table
gives no rows. Other columns are not looked at. Java's ``(?i)`` is used without Unicode, so only ASCII letters match in either case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafscan.llm import common as c
from leafscan.session import settle

# --- Fixed values: the base patterns -------------------------------------------------------------
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # equal to runs of AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"
RUN_CHARS = "A-Za-z0-9+/_=-"
# --- End of fixed values -------------------------------------------------------------------------
ALPHABET, FIRST = 95, 32  # printable ASCII; the blank stands for both ends of a run
RUN_ALPHABET = 66  # token characters and the end
CUT = 1000


@dataclass(frozen=True)
class Rule:
    train_chars: int = 12
    least_chars: int = 16
    least_ratio: float = 12.0
    uniform_share: float = 0.5
    prior: float = 0.5  # pseudo-count of each transition


def _found(text: Column, pattern: str) -> Column:
    """Matches of a pattern and the lengths of the pieces around them; null without a match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(F.size(hits) > 0, F.struct(hits.alias("hits"), gaps.alias("gaps")))


def scanned(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Settled matches of every kind in each document."""
    slim = docs.select(c.row_id(id_col).alias("doc_id"), c.text_of(text_col).alias("_text"), F.monotonically_increasing_id().alias("row"))
    patterns = (ASSIGN, ACCESS, HEX, f"[{RUN_CHARS}]{{{rule.train_chars},}}")
    return settle(slim.select("row", "doc_id", *[_found(F.col("_text"), p).alias(k) for k, p in zip(KINDS, patterns)]), "matches")


def _spans(found: DataFrame) -> DataFrame:
    """One row for each match (row, doc_id, kind number, hit, start, end) of documents with any; failing ones are still there."""
    each = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("kind"), F.col(f"{k}.hits").alias("hits"), F.col(f"{k}.gaps").alias("gaps"))) for i, k in enumerate(KINDS)])
    kinds = found.select("row", "doc_id", F.explode(each).alias("k")).filter("k is not null")
    hits = kinds.select("row", "doc_id", F.col("k.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("k.hits").alias("hits"), F.col("k.gaps").alias("gaps"))).alias("at", "m")).filter("m.hits is not null")
    size = F.length("m.hits")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gaps") + size).over(upto)
    return hits.select("row", "doc_id", "kind", F.col("m.hits").alias("hit"), (end - size).alias("start"), end.alias("end"))


def _valid(spans: DataFrame) -> DataFrame:
    """Base spans that do not fail; runs whatever they are."""
    return spans.filter((F.col("kind") > 0) | (F.length(F.regexp_extract("hit", ASSIGN, 2)) >= ASSIGN_CHARS))


def _apart(spans: DataFrame) -> DataFrame:
    """Spans with ``covered``: a run that meets a base span."""
    run = F.col("kind") == 3
    order = [F.col("start"), F.col("kind")]
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(*[x.desc() for x in order]).rowsBetween(Window.unboundedPreceding, -1)
    left = F.max(F.when(~run, F.col("end"))).over(before)
    right = F.min(F.when(~run, F.col("start"))).over(behind)
    return spans.withColumn("covered", run & (F.coalesce(left > F.col("start"), F.lit(False)) | F.coalesce(right < F.col("end"), F.lit(False))))


def _code(character: Column) -> Column:
    return F.ascii(character) - FIRST


def _cuts(hit: Column) -> Column:
    """A run with a blank at both ends, in cuts that share their border character."""
    return F.regexp_extract_all(F.concat(F.lit(" "), hit, F.lit(" ")), F.lit(rf"(?s)(?=(.{{1,{CUT + 1}}})).{{1,{CUT}}}"), F.lit(1))


def _steps(cut: Column) -> Column:
    """Numbers of the transitions in a cut: 95 x code + code of the next character."""
    step = lambda i: _code(F.substring(cut, i, F.lit(1))) * ALPHABET + _code(F.substring(cut, i + 1, F.lit(1)))
    return F.when(F.length(cut) > 1, F.transform(F.sequence(F.lit(1), F.length(cut) - 1), step)).otherwise(F.array().cast("array<int>"))


def transition_counts(spans: DataFrame) -> DataFrame:
    """Counts of transitions (random, step, n) in the labelled samples: base matches, without what stands before an assigned value, against free runs."""
    value = F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    # Patterns let the characters of a run and "." through; a dot ends a run.
    sample = spans.filter("not covered").select((F.col("kind") < 3).alias("random"), F.explode(F.split(value, r"\.")).alias("value")).filter("value <> ''")
    cuts = sample.select("random", F.explode(_cuts(F.col("value"))).alias("cut"))
    return cuts.select("random", F.explode(_steps(F.col("cut"))).alias("step")).groupBy("random", "step").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(counts: list, rule: Rule) -> list[float]:
    """Log-likelihood ratio of each transition, random against ordinary. ``counts`` are at most 2 x 95 x 95 rows."""
    tables = {True: [0.0] * ALPHABET ** 2, False: [0.0] * ALPHABET ** 2}
    for random, step, n in counts:
        tables[random][step] += n

    def chain(table: list[float], step: int) -> float:
        start = step - step % ALPHABET
        return (table[step] + rule.prior) / (totals[id(table)][start // ALPHABET] + rule.prior * RUN_ALPHABET)

    totals = {id(t): [sum(t[a * ALPHABET:(a + 1) * ALPHABET]) for a in range(ALPHABET)] for t in tables.values()}
    u = rule.uniform_share
    return [math.log(u / RUN_ALPHABET + (1 - u) * chain(tables[True], s)) - math.log(chain(tables[False], s)) for s in range(ALPHABET ** 2)]


def _scored(runs: DataFrame, ratios: list[float]) -> DataFrame:
    """Log-likelihood ratio of each free run (row, start, ratio)."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one constant
    of_cut = F.aggregate(_steps(F.col("cut")), F.lit(0.0), lambda total, step: total + F.element_at(table, step + 1))
    cuts = runs.select("row", "doc_id", "start", "end", F.posexplode(_cuts(F.col("hit"))).alias("at", "cut"))
    return cuts.select("row", "doc_id", "start", "end", of_cut.alias("ratio")).groupBy("row", "doc_id", "start", "end").agg(F.sum("ratio").alias("ratio"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and places of the secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scanned(docs, rule, id_col, text_col)
    any_hit = F.coalesce(*[F.col(f"{k}.hits") for k in KINDS]).isNotNull()
    spans = settle(_apart(_valid(_spans(found.filter(any_hit)))), "spans")
    counts = transition_counts(spans).collect()
    free = spans.filter(~F.col("covered") & (F.col("kind") == 3) & (F.length("hit") >= rule.least_chars))
    known = any(random for random, _, _ in counts)
    added = _scored(free, log_ratios(counts, rule)).filter((F.col("ratio") >= rule.least_ratio) & F.lit(known)).withColumn("kind", F.lit(3))
    slim = spans.filter("kind < 3").select("row", "doc_id", "kind", "start", "end").unionByName(added.select("row", "doc_id", "kind", "start", "end"))
    # A document whose matches all failed keeps an empty row.
    spare = found.filter(any_hit).select("row", "doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("kind", "int"), ("start", "long"), ("end", "long"))])
    listed = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))))
    grouped = slim.unionByName(spare).groupBy("row", "doc_id").agg(listed.alias("all")).withColumn("base", F.filter("all", lambda s: s["kind"] < 3))
    blank = found.filter(~any_hit).select("row", "doc_id", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("all")).withColumn("base", F.col("all"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return grouped.unionByName(blank).select("doc_id", number(0), number(1), number(2), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))
