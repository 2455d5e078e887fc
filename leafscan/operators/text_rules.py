"""Per-file text rules, all in one pass over the text: raw SQL (Q), ``paginate()`` wrappers (W),
GraphQL paging (G) and the file-level page-size test (A12 candidates).

Nothing here needs a shuffle. ``text_facts`` is the single scan the audit uses; the per-family
functions below it are the same expressions on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rulebook as rb
from ..functions import text as tx
from ..sources.files import is_code, is_sql
from . import lexer

# --- Fixed values: patterns ------------------------------------------------------------------
LIMIT = r"(?i)\bLIMIT\b"
OFFSET = r"(?i)\bOFFSET\b"
ORDER_BY = r"(?i)\bORDER\s+BY\b"
RANKING = r"(?i)\b(?:ROW_NUMBER|DENSE_RANK)\s*\("
OFFSET_FETCH = r"(?i)\bOFFSET\s+\d+\s+ROWS?\s+FETCH\s+NEXT\s+\d+\s+ROWS?\s+ONLY\b"
SELECT = r"(?i)\bSELECT\b"
FIRST_OFFSET = r"(?i)\bOFFSET\s+(\d+)\b"
FULL_SCAN = r"(?i)SELECT\s+\*\s+FROM\s+\w+"
WRAPPER = r"\bpaginate\s*\("
MATH_MIN = r"Math\.min\s*\("
MAX_NAME = r"(?i)max(?:PageSize|Limit|Take)"
WRAPPER_ORDER = r"(?:orderBy|sort|ORDER BY)"
GRAPHQL_WORDS = r"(?:first|after|before|last)"
CURSOR_ORDER = r"orderBy|sort"
QUERY_PAGE_SIZE = r"req\.query\.(?:limit|pageSize|first|take)"
# --- End of fixed values ---------------------------------------------------------------------

FAMILIES = ("Q", "W", "G", "A12")


def sql_conditions(text: Column) -> dict[str, Column]:
    """Q00: the text flags and the first numeric offset of one SQL file."""
    return {
        "has_limit": text.rlike(LIMIT),
        "has_offset": text.rlike(OFFSET),
        "has_order": text.rlike(ORDER_BY),
        "has_window": text.rlike(RANKING),
        "has_offset_fetch": text.rlike(OFFSET_FETCH),
        "has_select": text.rlike(SELECT),
        "has_full_scan": text.rlike(FULL_SCAN),
        # A failed cast raises inside the task and is slow; files without an offset skip it.
        "first_offset": F.nullif(F.regexp_extract(text, FIRST_OFFSET, 1), F.lit("")).try_cast("double"),
    }


def wrapper_line(text: Column) -> Column:
    """Line of the first ``paginate(``."""
    return tx.count_newlines(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(WRAPPER)) - 1)) + 1


def wrapper_context(text: Column, line: Column) -> Column:
    """That line with the lines around it."""
    first = F.greatest(F.lit(1), line - 1)
    return F.array_join(F.slice(F.split(text, "\n"), first, line + 2 - first), "\n")


def identifier_line(text: Column) -> Column:
    """The tokens of a file in one text, comments dropped and strings whole; a null text has none.

    Enough to tell which words occur as identifiers; no positions, so nothing is exploded.
    """
    return lexer.joined(text)


def graphql_conditions(line: Column) -> dict[str, Column]:
    return {
        "has_first": line.contains("\u0001first\u0001"),
        "has_after": line.contains("\u0001after\u0001"),
        "has_min": line.rlike("(?<!\u0001\\.)\u0001Math\u0001\\.\u0001min\u0001\\("),
    }


def text_facts(files: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Every text rule in one scan: ``rule_id`` is a fired rule or ``A12`` (candidate).

    The expensive tests become plain columns of one compiled projection, each evaluated once per
    file; the rules are then cheap conditions over those columns.
    """
    c = F.col
    text = c("content")
    flags: dict[str, Column] = {"head": tx.first_line(text)}
    tests: dict[str, Column] = {}
    if "Q" in families:
        flags |= {name: F.when(c("sql_file"), test) for name, test in sql_conditions(text).items()}
        tests |= {
            "Q01": c("has_offset"),
            "Q02": c("has_offset_fetch"),
            "Q03": c("has_select") & ~c("has_limit"),
            "Q04": c("has_offset") & ~c("has_order"),
            "Q05": c("first_offset") > rb.DEEP_OFFSET_THRESHOLD,
            "Q06": c("has_full_scan") & ~c("has_limit"),
            "Q07": c("has_window") & ~c("has_limit"),
        }
    if "W" in families:
        wraps = c("code_file") & text.rlike(WRAPPER)
        flags |= {
            "wrapper_line": F.when(wraps, wrapper_line(text)),
            "wrapper_capped": F.when(wraps, text.rlike(MATH_MIN) | text.rlike(MAX_NAME)),
            "wrapper_ordered": F.when(wraps, text.rlike(WRAPPER_ORDER)),
        }
        tests |= {"W01": ~c("wrapper_capped"), "W02": ~c("wrapper_ordered")}
    if "G" in families:
        flags |= {
            # Only these texts are handed to the lexer.
            "identifiers": identifier_line(F.when(c("code_file") & text.rlike(GRAPHQL_WORDS), text)),
            "cursor_ordered": F.when(c("code_file"), text.rlike(CURSOR_ORDER)),
        }
        g = graphql_conditions(c("identifiers"))
        tests |= {"G01": g["has_first"] & ~g["has_min"], "G02": g["has_after"] & ~c("cursor_ordered")}
    if "A12" in families:
        tests["A12"] = c("code_file") & text.rlike(QUERY_PAGE_SIZE)
    path = c("file_path")
    flagged = files.select("project", "file_path", "content", is_sql(path).alias("sql_file"), is_code(path).alias("code_file"))
    flagged = flagged.withColumns(flags)
    # Files without a fired rule have a null list and explode to nothing. A filter on the list would be pushed below the flags, to where
    # the optimizer works them out again, and so each pattern and the lexer would run twice over every text.
    fired = F.nullif(F.concat_ws(" ", *[F.when(test, F.lit(rule)) for rule, test in tests.items()]), F.lit(""))
    none = F.lit(None).cast("string")
    listed = flagged.select(
        "project", "file_path", "head", fired.alias("fired"),
        (F.when(c("wrapper_line").isNotNull(), wrapper_context(text, c("wrapper_line"))) if "W" in families else none).alias("context"),
        (c("wrapper_line") if "W" in families else F.lit(None)).cast("int").alias("wrapper_line"),
        (F.when(c("identifiers").contains("\u0001after\u0001"), "cursor").otherwise("none") if "G" in families else none).alias("first_strategy"))
    rule = c("rule_id")
    family = F.substring(rule, 1, 1)
    return listed.withColumn("rule_id", F.explode(F.split("fired", " "))).select(
        "project", "file_path", "rule_id",
        F.when(family == "Q", 1).otherwise(0).alias("grp"),
        F.when(family == "G", 1).when(family == "W", 2).otherwise(0).alias("detector"),
        F.when(family == "W", c("wrapper_line")).otherwise(1).alias("line"),
        F.when(family == "W", c("context")).when(rule == "A12", "").otherwise(c("head")).alias("code_snippet"),
        F.when(rule == "G01", c("first_strategy")).alias("strategy_seen"))


def sql_flags(files: DataFrame) -> DataFrame:
    flags = sql_conditions(F.col("content"))
    return files.filter(is_sql(F.col("file_path"))).select(
        "project", "file_path", *[x.alias(name) for name, x in flags.items()])


def sql_hits(files: DataFrame) -> DataFrame:
    """Q01-Q07."""
    return hit_rows(text_facts(files.filter(is_sql(F.col("file_path"))), ("Q",)))


def wrapper_sites(files: DataFrame) -> DataFrame:
    """W00."""
    text = F.col("content")
    found = files.filter(is_code(F.col("file_path")) & text.rlike(WRAPPER)).withColumn("line", wrapper_line(text))
    return found.select("project", "file_path", "line", wrapper_context(text, F.col("line")).alias("code_snippet"))


def wrapper_hits(files: DataFrame) -> DataFrame:
    """W01, W02."""
    return hit_rows(text_facts(files.filter(is_code(F.col("file_path")) & F.col("content").rlike(WRAPPER)), ("W",)))


def graphql_idents(files: DataFrame) -> DataFrame:
    """G00 with the words found as identifiers."""
    found = files.filter(is_code(F.col("file_path")) & F.col("content").rlike(GRAPHQL_WORDS))
    flags = graphql_conditions(F.col("identifiers"))
    return found.withColumn("identifiers", identifier_line(F.col("content"))).select(
        "project", "file_path", *[x.alias(name) for name, x in flags.items()])


def graphql_hits(files: DataFrame) -> DataFrame:
    """G01, G02."""
    return hit_rows(text_facts(files.filter(is_code(F.col("file_path")) & F.col("content").rlike(GRAPHQL_WORDS)), ("G",)))


def hit_rows(facts: DataFrame) -> DataFrame:
    """Fired rules of ``text_facts`` in the common shape of detector hits."""
    return facts.select(
        "project", "file_path", "rule_id", "grp", "detector",
        # The file-level page-size test comes after every positioned finding of its detector.
        F.when(F.col("rule_id") == "A12", 2_147_483_647).otherwise(0).alias("start"), F.lit(0).alias("stop"),
        F.col("line").alias("line_start"), F.col("line").alias("line_end"),
        "code_snippet", "strategy_seen", F.lit(None).cast("string").alias("evidence"))
