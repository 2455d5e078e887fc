"""The token job (T01-T07): JS/TS source text as relational facts.

For the facts, each file is lexed where it is read, and its tokens, as arrays of one row, are exchanged by a file key; the text is exchanged by the
same key, unless it is stored in buckets of it (``files.store``). Plain views (T01-T04) exchange the text alone and lex it behind the exchange. Behind the exchanges text and tokens of a file meet in an equi-join, and the tokens
of many files at a time are worked on as columns (``shapes``): rows of single tokens exist neither on the network nor in a sort.
Lexing knows modes (``lexer``): an expression in a template is code between ``${`` and its end, which
count as round brackets; text of templates and markup and type arguments are gaps between tokens.

``token_facts`` gives one long table, partitioned by fact kind when settled:

========== =============================================================================
call       a member call of interest: names of its chain prefix, position, text, first arguments
prop       a property of an object literal that is a call argument or a Query/Mutation map
declarator a ``limit/pageSize/first/take`` variable declarator
cap        a ``Math.min`` call that caps a page size
decorator  ``@Name("text")`` with the method it decorates
method     a class member that ends in a body
decl       a top-level function, class or variable
icall      a direct ``name(...)`` call inside a top-level declaration, unless an inner scope binds the name
link       a name or file that an import, export or require stands for
bad        lines of a statement that was left out because its brackets do not balance
========== =============================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.files import FILE_KEYS, buckets_of, file_keys
from . import lexer, shapes
from .shapes import CALL_NAMES_OF_INTEREST  # noqa: F401

# --- Fixed values: words that facts need -------------------------------------------------------
# A file without any of these words yields no call, prop, declarator, cap or decorator fact.
DEEP_WORDS = (
    r"skip|offset|findMany|findAll|sort|order|req\s*\.\s*query|Query|Mutation|Math"
    r"|\b(?:get|post|put|patch|delete|options|head)\b|@\s*(?:Get|Post|Put|Patch|Delete|Options|Head)\b"
)
DECORATOR_WORDS = r"@\s*(?:Get|Post|Put|Patch|Delete|Options|Head|Query|Mutation)\b"
# --- End of fixed values ---------------------------------------------------------------------


def unquote(t: Column) -> Column:
    return F.substring(t, F.lit(2), F.length(t) - 2)


# A task's share of the text. Its tokens, some twenty-five times as large, should stay in a task's memory.
TASK_BYTES = 2 << 20
MOST_PARTS = 20_000


def parts_of(files: DataFrame) -> int:
    """Partitions that code files are dealt to: by their bytes, but no fewer than ``spark.sql.shuffle.partitions``; a stored table has its buckets.

    The number is fixed before the exchange: text grows manyfold into tokens, so sizes measured there must not lead to merged partitions. With a
    number that does not grow with the text, partitions outgrow the memory of a task and its join and grouping spill.
    """
    buckets = buckets_of(files)
    if buckets:
        return buckets
    size = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // TASK_BYTES), MOST_PARTS))


def _keys(files: DataFrame) -> list[Column]:
    """The 128-bit file key of code files."""
    keys = [F.col(k) for k in FILE_KEYS] if buckets_of(files) else file_keys()
    return [k.alias(n) for k, n in zip(keys, ("h1", "h2"))]


def keyed(files: DataFrame, parts: int | None = None) -> DataFrame:
    """The text of code files, dealt by the file key; that of a stored table stays in its buckets."""
    rows = files.select(*_keys(files), "project", "file_path", "content")
    return rows if buckets_of(files) else rows.repartition(parts or parts_of(files), "h1", "h2")


def _lexed(files: DataFrame, deep: Column, decorated: Column, parts: int | None = None) -> DataFrame:
    """The tokens of each file, dealt by the file key.

    Rows with the same project and path are one file, each with its ``copies`` of tokens. Every text ends in an empty token, the last boundary, and
    its broken statements.
    """
    copy = F.struct(deep.alias("deep"), decorated.alias("decorated"), lexer.lexed(F.col("content")).alias("tokens"))
    rows = files.select(*_keys(files), copy.alias("copy")).repartition(parts or parts_of(files), "h1", "h2")
    return rows.groupBy("h1", "h2").agg(F.collect_list("copy").alias("copies"))


def _view(files: DataFrame, of_batches, schema: str, kept: str = "") -> DataFrame:
    """A plain view needs no text beside the tokens, so the text, far smaller than they are, is exchanged, and lexed where its tokens are worked on."""
    texts = F.collect_list(F.struct("content")).alias("texts")  # structs, as null texts count
    rows = keyed(files).groupBy("h1", "h2").agg(F.first("project").alias("project"), F.first("file_path").alias("file_path"), texts)
    return rows.drop("h1", "h2").mapInArrow(lexer.over_texts(of_batches, kept), schema)


def tokens(files: DataFrame) -> DataFrame:
    """Non-blank tokens of each file with their character offset and line, those of broken statements too."""
    return _view(files, shapes.all_tokens, shapes.TOKENS_SQL, "every")


def brackets(files: DataFrame) -> DataFrame:
    """Matching bracket pairs."""
    return _view(files, shapes.all_brackets, shapes.BRACKETS_SQL, "groups")


def member_calls(files: DataFrame) -> DataFrame:
    """Every member call with the names of its chain prefix."""
    return _view(files, shapes.all_calls, shapes.CALLS_SQL)


def token_facts(files: DataFrame, symbols: bool = True) -> DataFrame:
    """T02-T07 in one job; see the module text. ``files`` are code files (project, file_path, content).

    Without ``symbols`` (no call chains wanted) files that cannot yield any other fact are skipped
    before the exchange.
    """
    content = F.col("content")
    if not symbols:
        files = files.filter(content.rlike(DEEP_WORDS))
    parts = parts_of(files)
    rows = _lexed(files, content.rlike(DEEP_WORDS), content.rlike(DECORATOR_WORDS), parts=parts)
    # The text, far smaller than its tokens, is the hashed side.
    joined = rows.join(keyed(files, parts).hint("shuffle_hash"), ["h1", "h2"], "inner")
    return joined.select("project", "file_path", "content", "copies").mapInArrow(shapes.facts, shapes.FACTS_SQL)
