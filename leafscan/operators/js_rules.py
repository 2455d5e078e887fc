"""Rules A01-A12: filters over the facts of the token job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rulebook as rb

# --- Fixed values: patterns ------------------------------------------------------------------
QUERY_SORT = r"req\.query\.(?:sort|order|sortBy)"
QUERY_PAGE_SIZE = r"req\.query\.(?:limit|pageSize|first|take)"
MATH_MIN = r"Math\.min\("
CREATED_AT_RANGE = r"createdAt\s*:\s*\{\s*(?:gt|lt)"
ID_RANGE = r"(?:_id|id)\s*:\s*\{\s*(?:gt|lt)"
# --- End of fixed values ---------------------------------------------------------------------


def _any_of(names: Column, words) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(w) for w in words]))


def number_value(text: Column) -> Column:
    """Value of a numeric literal, with digit separators and hexadecimal."""
    plain = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(plain.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(plain, 3, 64), 16, 10).try_cast("double")).otherwise(
        plain.try_cast("double"))


def bad_files(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'bad'").select(
        "project", "file_path", F.lit("unbalanced brackets").alias("reason")).distinct()


def _hits(df: DataFrame, fired: Column, evidence: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "project", "file_path", "start", "stop", "line_start", "line_end", F.col("text").alias("code_snippet"),
        (none if evidence is None else evidence).alias("chain_text"), F.explode(fired).alias("rule_id"),
    ).select(
        "project", "file_path", "rule_id", F.lit(0).alias("grp"), F.lit(0).alias("detector"),
        "start", "stop", "line_start", "line_end", "code_snippet", none.alias("strategy_seen"),
        F.when(F.col("rule_id") == "A01", F.col("chain_text")).alias("evidence"))


def _fired(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]))


def chain_hits(facts: DataFrame) -> DataFrame:
    """Every prefix of a call chain is tested on its own."""
    c = F.col
    calls = facts.filter("fact = 'call'")
    skips = _any_of(c("names"), rb.OFFSET_CALLS)
    skip = F.array_contains("names", "skip")
    dynamic = (
        c("dotted") & c("name").isin(*rb.ORDER_CALLS) & c("arg0_kind").isin("member", "identifier")
        & c("arg0_text").rlike(QUERY_SORT) & ~c("arg0_text").rlike(r"^(?:await|new|typeof|void|delete)\b"))
    return _hits(calls, _fired({
        "A01": skips,
        "A02": skips & ~_any_of(c("names"), rb.LIMIT_CALLS),
        "A03": skips & ~_any_of(c("names"), rb.ORDER_CALLS),
        "A04": skip & (c("arg0_kind") == "number") & (number_value(c("arg0_text")) > rb.DEEP_OFFSET_THRESHOLD),
        "A05": skip & (c("arg0_kind") == "expression") & c("mult"),
        "A10": dynamic,
    }), F.array_join("names", " -> "))


def query_objects(facts: DataFrame) -> DataFrame:
    """Calls of ``findMany``/``findAll`` with an object argument, and which properties it has.

    Calls and properties meet in one grouping on the call's position instead of a join.
    """
    c = F.col
    is_call = c("fact") == "call"
    rows = facts.filter(
        (is_call & c("name").isin(*rb.QUERY_OBJECT_CALLS) & (c("arg0_kind") == "object"))
        | ((c("fact") == "prop") & (c("owner") == "arg"))
    ).withColumn("call_n", F.when(is_call, c("n")).otherwise(c("parent")))

    def has(*words):
        return F.coalesce(F.bool_or(~is_call & c("name").isin(*words)), F.lit(False))

    def of_call(name):
        return F.first(F.when(is_call, c(name)), ignorenulls=True).alias(name)

    return rows.groupBy("project", "file_path", "call_n").agg(
        *[of_call(x) for x in ("start", "stop", "line_start", "line_end", "text")],
        has("skip", "offset").alias("has_skip"), has("take", "limit").alias("has_take"),
        has("orderBy", "order").alias("has_order"), has("cursor").alias("has_cursor"),
        has("where").alias("has_where"),
        F.min_by(F.when(~is_call & (c("name") == "where"), c("text")),
                 F.when(~is_call & (c("name") == "where"), c("n"))).alias("where_text"),
    ).filter("start IS NOT NULL")


def object_hits(facts: DataFrame) -> DataFrame:
    """A06-A09."""
    c = F.col
    where = F.coalesce(c("where_text"), F.lit(""))
    loose_cursor = where.rlike(CREATED_AT_RANGE) & ~where.rlike(ID_RANGE)
    return _hits(query_objects(facts), _fired({
        "A06": c("has_skip"),
        "A07": c("has_skip") & ~c("has_take"),
        "A08": c("has_skip") & ~c("has_order"),
        "A09": (c("has_cursor") | c("has_where")) & (~c("has_order") | loose_cursor),
    }))


def declarator_hits(facts: DataFrame) -> DataFrame:
    """A11."""
    text = F.col("text")
    return _hits(
        facts.filter("fact = 'declarator'"),
        _fired({"A11": text.rlike(QUERY_PAGE_SIZE) & ~text.rlike(MATH_MIN)}))


def capped_files(facts: DataFrame) -> DataFrame:
    """Files with a ``Math.min`` that caps a page size."""
    return facts.filter("fact = 'cap'").select("project", "file_path").distinct()


def js_hits(facts: DataFrame) -> DataFrame:
    """A01-A11."""
    return chain_hits(facts).unionByName(object_hits(facts)).unionByName(declarator_hits(facts))


def page_size_hits(text_hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates of the text pass without a capping call in the file."""
    return text_hits.filter("rule_id = 'A12'").join(capped_files(facts), ["project", "file_path"], "left_anti")
