"""Shapes of code: what the tokens of many files mean, worked out on columns.

A batch holds the tokens of some files side by side, as numpy columns in the order of the files. ``Runs`` gives what running windows over groups
of rows give (last row that meets a test, running sums, neighbours) for all groups at once, so each rule is one expression over all tokens of a
batch; nothing here works token by token. ``tokens`` says which rows are dealt to a task and what becomes of them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import SimpleNamespace as Columns

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle

from .. import rulebook as rb
from .lexer import BROKEN as BROKEN_MARK, LINK as LINK_MARK, TEMPLATE_CLOSE, TEMPLATE_OPEN

# --- Fixed values: words and token sets --------------------------------------------------------
VARIABLE_WORDS = ("const", "let", "var")
# Words that can stand before "(" without being called.
CALL_STOP_WORDS = (
    "if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "super",
    "import", "async", "with", "in", "of", "instanceof", "void", "delete", "throw", "case", "do", "else", "yield",
)
# Words after which a bracket or name starts a new expression.
PREFIX_WORDS = (
    "return", "await", "typeof", "void", "delete", "throw", "case", "in", "of", "instanceof", "yield",
    "else", "do", "if", "for", "while", "switch", "catch", "default", "export", "extends", "as",
    "const", "let", "var", "function", "class", "async",
)
MULTIPLICATIVE = ("*", "/", "%")
# Operators that bind weaker than multiplication, and words that make an argument something else.
WEAKER = (
    "+", "-", "<", ">", "<=", ">=", "==", "===", "!=", "!==", "&", "|", "^", "&&", "||", "??", "?", "=>",
    "=", "+=", "-=", "*=", "/=", "%=", "in", "instanceof", "as", "satisfies", "yield", "function", "class",
)
CALL_NAMES_OF_INTEREST = (
    *rb.OFFSET_CALLS, *rb.QUERY_OBJECT_CALLS, *rb.ORDER_CALLS, *rb.HTTP_METHODS,
)
# --- End of fixed values ---------------------------------------------------------------------

# What a token is, as bits of one number: tests on a token and its neighbours are integer masks.
WORD, STRING, NUMBER, TEMPLATE, BROKEN, LINK = 1, 2, 4, 8, 16, 32
TOKEN_SETS = {
    "dot": (".",), "chain": ("?.",), "(": ("(", TEMPLATE_OPEN), ")": (")", TEMPLATE_CLOSE), "[": ("[",), "]": ("]",), "{": ("{",), "}": ("}",),
    ",": (",",), ";": (";",), ":": (":",), "=": ("=",), "@": ("@",), "*": ("*",), "=>": ("=>",), "sign": ("+", "-"),
    "member_start": ("@", "#", "*", "["), "variable": VARIABLE_WORDS, "prefix": PREFIX_WORDS, "call_stop": CALL_STOP_WORDS,
    "weaker": WEAKER, "multiplicative": MULTIPLICATIVE, "joined": ("instanceof", "in", "as", "of", "satisfies"),
    "function": ("function",), "class": ("class",), "default": ("default",), "async": ("async",), "new": ("new",),
    "statement_word": ("export", "default", "async", "declare", "abstract"),
    "before_async_function": ("=", "(", ",", "=>", "return", ":"),
    "no_call_before": (".", "?.", "function", "new", "async", "*", "get", "set", "static", "#", "@"),
    "page_size": rb.PAGE_SIZE_NAMES,
    "query_object": tuple(q + n + q for n in rb.QUERY_OBJECT_CALLS for q in ("", '"', "'")),
    "graphql_type": tuple(q + n + q for n in rb.GRAPHQL_TYPES for q in ("", '"', "'")),
    "type_word": ("type", "interface"), "min": ("min",), "Math": ("Math",), "query": ("query",), "req": ("req",), "end": ("",),
}
BIT = {name: 1 << (6 + i) for i, name in enumerate(TOKEN_SETS)}
_TOKEN_BITS: dict[str, int] = {}
for _name, _members in TOKEN_SETS.items():
    for _token in _members:
        _TOKEN_BITS[_token] = _TOKEN_BITS.get(_token, 0) | BIT[_name]

# Openers of interest: what stands before a bracket, decided once per bracket.
DOT_CALL, TEXT_CALL, MIN_CALL, DECORATOR, QUERY_OBJECT, GRAPHQL_MAP = 1, 2, 3, 4, 5, 6

# Tokens that are worked on at a time; a file is not cut.
SLICE_TOKENS = 1 << 16

# This module travels with its functions: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NAME_START = regex.compile(r"[\p{L}_$]").match


def _bits(t: str) -> int:
    """Bits of a token: its class from the first character, the rest from one table lookup."""
    first = t[:1]
    if _NAME_START(first):
        klass = WORD
    elif first in ('"', "'") and len(t) > 1:
        klass = STRING
    else:
        klass = TEMPLATE if first == "`" else NUMBER if "0" <= first <= "9" else BROKEN if first == BROKEN_MARK else LINK if first == LINK_MARK else 0
    return klass | _TOKEN_BITS.get(t, 0)


def _has(bits: np.ndarray, *sets: str | int) -> np.ndarray:
    mask = 0
    for x in sets:
        mask |= x if isinstance(x, int) else BIT[x]
    return (bits & mask) != 0


def unquote(t: str) -> str:
    return t[1:-1]


def _at(values: np.ndarray, rows: np.ndarray, none) -> np.ndarray:
    """Values at rows; ``none`` where there is no row (-1)."""
    return np.where(rows >= 0, values[rows], none)


class Runs:
    """Rows in groups that follow each other; ``begins`` marks the first row of each group."""

    def __init__(self, begins: np.ndarray):
        self.rows = np.arange(len(begins))
        self.start = np.maximum.accumulate(np.where(begins, self.rows, 0))
        self.begins = begins

    def last(self, test: np.ndarray) -> np.ndarray:
        """The last row of the group so far that meets a test, itself included; -1 if there is none."""
        found = np.maximum.accumulate(np.where(test, self.rows, -1))
        return np.where(found >= self.start, found, -1)

    def before(self, test: np.ndarray) -> np.ndarray:
        """The last row of the group before this one that meets a test."""
        return self.lag(self.last(test), 1, -1)

    def sum(self, values: np.ndarray) -> np.ndarray:
        total = np.cumsum(values, dtype=np.int64)
        return total - (total - values)[self.start]

    def sum_before(self, values: np.ndarray) -> np.ndarray:
        return self.sum(values) - values

    def lag(self, values: np.ndarray, by: int, none) -> np.ndarray:
        out = np.full_like(values, none)
        out[by:] = values[:-by]
        return np.where(self.rows - by >= self.start, out, none)

    def lead(self, values: np.ndarray, by: int, none) -> np.ndarray:
        out = np.full_like(values, none)
        out[:-by] = values[by:]
        group = np.full(len(values), -1)
        group[:-by] = self.start[by:]
        return np.where(group == self.start, out, none)


def numbered(copies: pa.ListArray, bits: Callable[[str], int] = _bits) -> Columns:
    """Tokens with offsets, lines and bracket depth.

    ``copies`` holds for each file its lexed texts with ``deep`` and ``decorated``. Rows with the same project and path are one file: their tokens are
    put together by their numbers.
    """
    each = copies.flatten()
    lexed = each.field("tokens")
    of_file = np.repeat(np.arange(len(copies)), copies.value_lengths().to_numpy(zero_copy_only=False))
    counts = pc.list_value_length(lexed.field("t")).to_numpy(zero_copy_only=False)
    words = lexed.field("t").flatten().dictionary_encode()
    known = words.dictionary.to_pylist()
    flat = lambda name: lexed.field(name).flatten().to_numpy(zero_copy_only=False)
    told = lambda name: np.repeat(pc.fill_null(each.field(name), False).to_numpy(zero_copy_only=False), counts)
    c = Columns(word=words.indices.to_numpy(zero_copy_only=False).astype(np.int64), gap=flat("gap").astype(np.int64), gap_lines=flat("lines").astype(np.int64),
                local=flat("local"), wrap=flat("wrap"), deep=told("deep"), decorated=told("decorated"), file=np.repeat(of_file, counts))
    c.n = np.arange(len(c.word)) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(of_file) > len(copies):
        order = np.lexsort((c.n, c.file))
        c = Columns(**{name: values[order] for name, values in vars(c).items()})
    c.known = known
    b = c.b = np.array([bits(w) for w in known], np.int64)[c.word]
    size = np.array([len(w) for w in known], np.int64)[c.word]
    own_lines = np.array([w.count("\n") for w in known], np.int64)[c.word]
    runs = c.runs = Runs(np.diff(c.file, prepend=-1) != 0)
    c.pos = runs.sum(c.gap + size) - size
    c.line = 1 + runs.sum(c.gap_lines + own_lines) - own_lines
    c.opens, c.closes = _has(b, "(", "[", "{"), _has(b, ")", "]", "}")
    c.bracket = c.opens | c.closes
    c.lvl = runs.sum(c.opens.astype(np.int64) - c.closes) + c.closes
    return c


def placed(copies: pa.ListArray) -> Columns:
    """Tokens with offsets, lines, bracket depth and neighbours."""
    c = numbered(copies)
    b, runs = c.b, c.runs
    c.b1, c.b2, c.b3, c.b4 = (runs.lag(b, k, 0) for k in (1, 2, 3, 4))
    c.y1, c.y2 = (runs.lead(b, k, 0) for k in (1, 2))
    c.prev_end, c.prev_line = c.pos - c.gap, c.line - c.gap_lines
    return c


def owned(c: Columns) -> Columns:
    """Top-level statements, the declaration each token belongs to, and what the tests on levels need to know about the neighbours."""
    runs, rows = c.runs, c.runs.rows
    b, b1, b2, b3, b4, y1, y2 = c.b, c.b1, c.b2, c.b3, c.b4, c.y1, c.y2
    final = runs.lead(rows, 1, -1) < 0
    top = c.lvl == c.bracket
    new_line = c.gap_lines > 0
    ends = top & (_has(b, ";") | (_has(b, "}") & (_has(y1, WORD, "end", ";", "@") | final)))
    first = (c.n == 0) | _has(b1, ";", "}", "statement_word") | new_line
    function = top & _has(b, "function") & first & ~(_has(b1, "async") & _has(b2, "before_async_function"))
    named = function | (top & _has(b, "class") & first) | (top & _has(b, "variable"))
    # Rows of the tokens that name things; -1: none.
    c.decl = np.where(function & _has(y1, "*") & _has(y2, WORD), rows + 2, np.where(named & _has(y1, WORD), rows + 1, -1))
    round_open = _has(b, "(")
    c.is_icall = round_open & _has(b1, WORD) & ~_has(b1, "call_stop") & ~_has(b2, "no_call_before") & ~c.local
    dot_call = round_open & _has(b2, "dot") & _has(b1, WORD)
    text_call = round_open & _has(b1, "]") & _has(b2, STRING) & _has(b3, "[")
    decorator = round_open & _has(b2, "@") & _has(b1, WORD)
    curly_open = _has(b, "{")
    query_object = curly_open & _has(b1, "(") & (
        (_has(b3, "dot") & _has(b2, "query_object") & _has(b2, WORD)) | (_has(b2, "]") & _has(b3, "query_object") & _has(b3, STRING)))
    graphql_map = curly_open & _has(b1, ":") & _has(b2, "graphql_type") & _has(b3, "{", ",")
    form = np.select(
        [dot_call & _has(b1, "min") & _has(b3, "Math") & ~_has(b4, "dot"), dot_call, text_call, decorator, query_object, graphql_map, c.opens],
        [MIN_CALL, DOT_CALL, TEXT_CALL, DECORATOR, QUERY_OBJECT, GRAPHQL_MAP, 0], -1)
    c.label = np.where(dot_call | decorator, rows - 1, np.where(text_call | graphql_map, rows - 2, -1))
    operand = (_has(b1, WORD) & ~_has(b1, "prefix")) | _has(b1, ")", "]")
    operand_end = operand | _has(b1, STRING, NUMBER, TEMPLATE, "}")
    c.begins = (
        (c.n == 0) | _has(b1, ";") | _has(b, "variable")
        | (_has(b1, "}") & _has(b, WORD, STRING, NUMBER, TEMPLATE, "@") & ~_has(b, "joined"))
        | (new_line & operand_end & _has(b, WORD, NUMBER, "@") & ~_has(b, "joined")))
    c.continues = (
        _has(b, "dot", "chain") | _has(b1, "dot", "chain", "new") | c.closes
        | (_has(b, "(", "[") & (operand | _has(b1, STRING, TEMPLATE))) | (_has(b, TEMPLATE) & operand))
    c.is_default = _has(b1, "default") | _has(b2, "default")
    c.is_query_size = _has(b1, "dot") & _has(b2, "query") & _has(b3, "dot") & _has(b4, "req")
    # What a text call takes its bracket from.
    c.text_base = _has(b4, WORD, ")", "]")
    c.member_end = _has(b, ";") | (_has(b, "}") & (_has(y1, WORD, STRING, "member_start", "}", ";", "end") | final))
    c.method_name = _has(b, WORD) & _has(y1, "(") & ~_has(b1, "@", "dot", "chain", "new") & ~_has(b, "call_stop")
    segment = runs.sum_before(ends.astype(np.int64))
    # A map inside a type or interface declares shapes, not resolvers.
    typed = _at(segment, runs.last(top & first & _has(b, "type_word") & _has(y1, WORD)), -1) == segment
    c.form = np.where((form == GRAPHQL_MAP) & typed, 0, form)
    owner = runs.last(c.decl >= 0)
    c.owner = np.where(_at(segment, owner, -1) == segment, _at(c.decl, owner, -1), -1)
    return c


# What the rules on levels read of a token.
_CARRIED = ("file", "n", "b", "b1", "y1", "pos", "line", "lvl", "prev_end", "prev_line", "opens", "closes", "begins", "continues", "wrap", "form", "label",
            "text_base", "member_end", "method_name", "decorated", "is_query_size", "word")


def levels(c: Columns) -> Columns:
    """Two views of each bracket: an item of its parent level, and the border of its own level. Rows by file, level and token."""
    item = c.deep | _has(c.b, "end", BROKEN, LINK)
    border = np.flatnonzero(c.deep & c.bracket)
    item = np.flatnonzero(item)
    token = np.concatenate([item, border])
    level = np.concatenate([c.lvl[item] - (c.bracket & c.deep)[item], c.lvl[border]])
    order = np.lexsort((token, level, c.file[token]))
    s = Columns(token=token[order], level=level[order], border=np.arange(len(token))[order] >= len(item), known=c.known)
    for name in _CARRIED:
        setattr(s, name, getattr(c, name)[s.token])
    s.item = ~s.border
    s.runs = Runs((np.diff(s.file, prepend=-1) != 0) | (np.diff(s.level, prepend=0) != 0))
    # Words by the row of a token.
    s.words = c.word
    return s


def structured(s: Columns) -> Columns:
    """Expression runs, enclosing groups, call chains and argument facts. A column of rows holds -1 where there is none."""
    runs, b, b1, item, n = s.runs, s.b, s.b1, s.item, s.n
    last, before = runs.last, runs.before
    border_open = s.border & s.opens
    begins = item & s.begins & ~s.closes
    s.boundary = s.border | (item & (_has(b, ",", ";", "end") | begins))
    comma = item & _has(b, ",")
    variable = item & _has(b, "variable")
    commas = runs.sum(comma.astype(np.int64))
    # Behind brackets that were left out the expression begins where they do.
    s.head = last(item & (~s.continues | (s.wrap > 0)))
    s.head_pos, s.head_line = s.pos - (s.wrap >> 32), s.line - (s.wrap & 0xFFFFFFFF)
    optional = last(item & _has(b, "chain"))
    s.open_item = last(item & s.opens)
    s.group = last(border_open)
    s.prev_boundary = _at(n, before(s.boundary), -1)
    variable_n = _at(n, last(variable), -1)
    statement_n = _at(n, last(item & (_has(b, ";") | (begins & ~variable))), -1)
    s.members = runs.sum_before((item & s.member_end).astype(np.int64))
    s.method = last(item & s.decorated & s.method_name)

    o = s.open_item
    s.open_form = _at(s.form, o, -1)
    called = np.isin(s.open_form, (DOT_CALL, MIN_CALL)) | ((s.open_form == TEXT_CALL) & _at(s.text_base, o, False))
    s.is_call = item & _has(b, ")") & called & ~((optional >= 0) & (s.head >= 0) & (n[optional] > n[s.head]))
    # The token before the "." or "[" of the call: a chain goes on if a member call closes there.
    link = n[o] - np.where(s.open_form == TEXT_CALL, 4, 3)
    arg = commas - _at(commas, s.group, 0)
    prev_call = before(s.is_call)

    group_n = s.group_n = _at(n, s.group, -1)
    s.group_form = _at(s.form, s.group, -1)
    in_call = (s.group_form >= DOT_CALL) & (s.group_form <= DECORATOR)
    in_object = s.group_form >= QUERY_OBJECT
    arg0, arg1 = in_call & (arg == 0), in_call & (arg == 1)
    key = item & in_object & _has(b1, "{", ",") & _has(b, WORD, STRING) & _has(s.y1, ":", ",", "}")
    named_in_list = _has(b1, ",") & (variable_n > np.maximum(statement_n, group_n))
    declared = item & _has(b, "page_size") & _has(s.y1, "=", ":") & (_has(b1, "variable") | named_in_list)
    unary = (n == 0) | _has(b1, "(", ",", "weaker", "multiplicative")
    weak = item & arg0 & _has(b, "weaker") & ~(_has(b, "sign") & unary)
    # Plain property access keeps an argument a member expression; anything else does not.
    odd = item & ~_has(b, WORD, "dot", "[", "]")
    s.key, s.declared = last(key), last(declared)
    s.comma1, s.comma2 = last(comma & arg1), last(comma & in_call & (arg == 2))
    s.item1, s.item2 = last(item & in_call & (n == group_n + 1)), last(item & arg1 & _has(b1, ","))
    s.strong = last(item & arg0 & _has(b, "multiplicative"))
    s.weak_n, s.odd_n, s.odd2_n, s.arrow1_n = (
        _at(n, last(x), -1) for x in (weak, odd & arg0, odd & arg1 & ~_has(b, ","), item & arg1 & _has(b, "=>", "function")))
    s.chain = _at(n, last(s.is_call & ((prev_call < 0) | (n[prev_call] != link))), -1)
    return s


def shapes(copies: pa.ListArray) -> tuple[Columns, Columns]:
    c = owned(placed(copies))
    return c, structured(levels(c))


# --- facts -------------------------------------------------------------------------------------

FACTS = pa.schema([
    ("project", pa.string()), ("file_path", pa.string()), ("fact", pa.string()), ("n", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
    ("line_start", pa.int32()), ("line_end", pa.int32()), ("name", pa.string()), ("names", pa.list_(pa.string())), ("text", pa.string()),
    ("arg0_kind", pa.string()), ("arg0_text", pa.string()), ("arg1_kind", pa.string()), ("arg1_text", pa.string()), ("mult", pa.bool_()), ("dotted", pa.bool_()),
    ("owner", pa.string()), ("parent", pa.int32()), ("member", pa.int64()), ("symbol", pa.string()), ("is_default", pa.bool_())])
FACTS_SQL = """project string, file_path string, fact string, n int, start int, stop int, line_start int, line_end int, name string, names array<string>, text string,
    arg0_kind string, arg0_text string, arg1_kind string, arg1_text string, mult boolean, dotted boolean, owner string, parent int, member bigint, symbol string, is_default boolean"""


def _firsts(file: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a file and a token, in order, and the first place of each."""
    return np.unique((file << 32) + n, return_index=True)


def _shown(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~there)


def _arguments(s: Columns, rows: np.ndarray) -> Columns:
    """First two arguments of the calls that close at ``rows``, borders of their brackets."""
    g, n = s.group_n[rows], s.n[rows]

    def argument(first, there, comma, odd_n, arrow_n=None):
        end = s.comma1[rows] if comma == 1 else s.comma2[rows]
        end = np.where((end >= 0) & (s.n[end] > g), end, rows)
        b, single = s.b[first], s.n[end] == s.n[first] + 1
        kinds = [(single & _has(b, STRING), "string"), (single & _has(b, NUMBER), "number"), (single & _has(b, WORD), "identifier")]
        if arrow_n is not None:
            kinds.append((arrow_n[rows] > g, "function"))
        kinds += [(_has(b, WORD) & ~(odd_n[rows] > g), "member"), (_has(b, "{"), "object")]
        kind = np.select([x for x, _ in kinds], [np.array(x, object) for _, x in kinds], "expression")
        return Columns(first=first, there=there, end_n=s.n[end], start=s.pos[first], stop=s.prev_end[end], kind=np.where(there, kind, None))

    first, second = s.item1[rows], s.item2[rows]
    one = argument(first, (first >= 0) & (s.n[first] == g + 1) & (s.n[first] < n), 1, s.odd_n)
    two = argument(second, (second >= 0) & (s.n[second] > g) & (s.n[second] < n), 2, s.odd2_n, s.arrow1_n)
    strong = s.strong[rows]
    mult = ~(s.weak_n[rows] > g) & (strong >= 0) & (s.n[strong] > g) & _has(s.b[strong], "*")
    return Columns(one=one, two=two, mult=mult)


class _Text:
    """Texts of the files of a batch, and of their tokens."""

    def __init__(self, s: Columns, contents: list[str | None]):
        self.s, self.contents = s, contents

    def part(self, file: np.ndarray, start: np.ndarray, stop: np.ndarray, there: np.ndarray) -> list[str | None]:
        texts = self.contents
        return [None if not ok or texts[f] is None else texts[f][a:max(a, b)] for f, a, b, ok in zip(file.tolist(), start.tolist(), stop.tolist(), there.tolist())]

    def of(self, word: np.ndarray) -> list[str]:
        known = self.s.known
        return [known[w] for w in word.tolist()]

    def label(self, token: np.ndarray) -> list[str]:
        """Words of tokens by their rows, strings without their quotes."""
        known = self.s.known
        return [unquote(w) if w[:1] in ('"', "'") else w for w in (known[k] for k in self.s.words[token].tolist())]


def _chains(file: np.ndarray, level: np.ndarray, chain: np.ndarray, n: np.ndarray, name: list[str], wanted: frozenset[str] | None) -> list[list[str] | None]:
    """The names of each call's chain prefix; None for chains without a wanted name so far."""
    out: list[list[str] | None] = [None] * len(name)
    key, names, found = None, [], False
    files, levels_, chains = file.tolist(), level.tolist(), chain.tolist()
    for k in np.lexsort((n, chain, level, file)).tolist():
        if (files[k], levels_[k], chains[k]) != key:
            key, names, found = (files[k], levels_[k], chains[k]), [], wanted is None
        names.append(name[k])
        found = found or name[k] in wanted
        if found:
            out[k] = names[:]
    return out


def _calls(s: Columns, text: _Text) -> dict:
    rows = np.flatnonzero(s.is_call)
    key, at = _firsts(s.file[rows], s.n[s.open_item[rows]])
    rows = rows[at]
    o, head = s.open_item[rows], s.head[rows]
    name = text.label(s.label[o])
    names = _chains(s.file[rows], s.level[rows], s.chain[rows], s.n[o], name, frozenset(CALL_NAMES_OF_INTEREST))
    kept = np.array([x is not None for x in names], bool)
    key, rows, o, head, names = key[kept], rows[kept], o[kept], head[kept], [x for x in names if x is not None]
    # The arguments are seen from inside the brackets.
    inside = np.flatnonzero(s.border & _has(s.b, ")") & (s.group_form >= DOT_CALL) & (s.group_form <= MIN_CALL))
    inner, at = _firsts(s.file[inside], s.group_n[inside])
    place = np.minimum(np.searchsorted(inner, key), max(len(inner) - 1, 0))
    there = inner[place] == key if len(inner) else np.zeros(len(key), bool)
    a = _arguments(s, inside[at][place] if len(inner) else np.zeros(len(key), np.int64))
    file, has_head = s.file[rows], head >= 0
    start, stop = s.head_pos[head], s.pos[rows] + 1
    kinds = lambda x: [k if ok else None for k, ok in zip(x.kind.tolist(), there.tolist())]
    return {
        "file": file, "n": s.n[o], "start": _shown(start, has_head), "stop": stop, "line_start": _shown(s.head_line[head], has_head), "line_end": s.line[rows],
        "name": [x[-1] for x in names], "names": names, "text": text.part(file, start, stop, has_head),
        "arg0_kind": kinds(a.one), "arg0_text": text.part(file, a.one.start, a.one.stop, a.one.there & there),
        "arg1_kind": kinds(a.two), "arg1_text": text.part(file, a.two.start, a.two.stop, a.two.there & there),
        "mult": _shown(a.mult, there), "dotted": s.form[o] != TEXT_CALL}


def _distinct(s: Columns, test: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that meet a test, one for each token ``at`` which the fact stands."""
    rows = np.flatnonzero(test)
    return rows[_firsts(s.file[rows], at[rows])[1]]


def _props(s: Columns, text: _Text) -> dict:
    closes_piece = (s.item & _has(s.b, ",")) | (s.border & s.closes)
    key_n = _at(s.n, s.key, -2)
    rows = _distinct(s, (s.group_form >= QUERY_OBJECT) & closes_piece & (key_n == s.prev_boundary + 1), key_n)
    key, group, n = s.key[rows], s.group[rows], s.n[rows]
    file, start, stop = s.file[rows], s.pos[key], s.prev_end[rows]
    short = n == s.n[key] + 1
    named = (n == s.n[key] + 3) & _has(s.b1[rows], WORD) & _has(s.b[rows], ",", "}")
    symbol = text.of(np.where(short, s.word[key], s.words[s.token[rows] - 1]))
    is_map = s.form[group] == GRAPHQL_MAP
    owner = text.label(np.where(is_map, s.label[group], s.token[rows]))
    return {
        "file": file, "n": s.n[key], "start": start, "stop": stop, "line_start": s.line[key], "line_end": s.prev_line[rows], "name": text.label(s.token[key]),
        "text": text.part(file, start, stop, np.ones(len(rows), bool)), "owner": [x if ok else "arg" for x, ok in zip(owner, is_map.tolist())],
        "parent": s.n[group] - 1, "symbol": [x if ok else None for x, ok in zip(symbol, (short | named).tolist())]}


def _declarators(s: Columns, text: _Text) -> dict:
    declared_n = _at(s.n, s.declared, -2)
    rows = _distinct(s, s.boundary & ~(s.border & s.opens) & (declared_n == s.prev_boundary + 1), declared_n)
    d = s.declared[rows]
    file, start, stop = s.file[rows], s.pos[d], s.prev_end[rows]
    return {"file": file, "n": s.n[d], "start": start, "stop": stop, "line_start": s.line[d], "line_end": s.prev_line[rows], "name": text.of(s.word[d]),
            "text": text.part(file, start, stop, np.ones(len(rows), bool))}


def _caps(s: Columns, text: _Text) -> dict:
    in_list = _has(s.b1, "(", ",")
    rows = _distinct(s, (s.group_form == MIN_CALL) & s.item & _has(s.b, "page_size") & _has(s.y1, ",", ")") & (
        in_list | (s.is_query_size & (_at(s.n, s.head, -9) == s.n - 4) & _at(in_list, s.head, False))), s.n)
    return {"file": s.file[rows], "n": s.n[rows]}


def _decorators(s: Columns, text: _Text) -> dict:
    """A decorator is seen from outside (which member it precedes) and from inside (its argument)."""
    rows = _distinct(s, s.item & _has(s.b, ")") & (s.open_form == DECORATOR), _at(s.n, s.open_item, -1))
    o = s.open_item[rows]
    inside = np.flatnonzero(s.border & _has(s.b, ")") & (s.group_form == DECORATOR))
    a = _arguments(s, inside).one
    literal = a.there & _has(s.b[a.first], STRING) & (a.end_n == s.n[a.first] + 1)
    paths = {}
    for f, n, word, ok in zip(s.file[inside].tolist(), s.group_n[inside].tolist(), s.word[a.first].tolist(), literal.tolist()):
        paths.setdefault((f, n), unquote(s.known[word]) if ok else None)
    file, at = s.file[rows], s.n[o]
    return {"file": file, "n": at, "line_start": s.line[o], "line_end": s.line[o], "name": text.label(s.label[o]), "parent": _shown(s.group_n[rows], s.group[rows] >= 0),
            "member": s.members[rows], "symbol": [paths.get(x) for x in zip(file.tolist(), at.tolist())]}


def _methods(s: Columns, text: _Text) -> dict:
    curly = lambda rows: _has(_at(s.b, rows, 0), "{")
    rows = _distinct(s, s.item & s.member_end & s.decorated & curly(s.group) & _has(s.b, "}") & curly(s.open_item) & (_at(s.n, s.method, -1) > s.group_n), s.n)
    return {"file": s.file[rows], "n": s.n[rows], "line_start": s.line[rows], "line_end": s.line[rows], "name": text.of(s.word[s.method[rows]]),
            "parent": s.group_n[rows], "member": s.members[rows]}


def _symbols(c: Columns, text: _Text) -> Iterator[tuple[str, dict]]:
    """Declarations, and direct calls inside them; repeated calls of a name in one declaration are one fact."""
    def fact(rows, name):
        return {"file": c.file[rows], "n": c.n[rows], "line_start": c.line[rows], "line_end": c.line[rows], "name": text.of(c.word[name]),
                "owner": text.of(c.word[c.owner[rows]]), "is_default": c.is_default[rows]}

    rows = np.flatnonzero(c.decl >= 0)
    rows = rows[_firsts(c.file[rows], c.n[rows])[1]]
    yield "decl", fact(rows, c.decl[rows])
    rows = np.flatnonzero((c.decl < 0) & c.is_icall & (c.owner >= 0))
    pairs = np.unique(c.word[c.owner[rows]] * len(c.known) + c.word[rows - 1], return_inverse=True)[1]
    rows = rows[_firsts(c.file[rows], pairs)[1]]
    yield "icall", fact(rows, rows - 1)


def _broken(s: Columns, text: _Text) -> dict:
    rows = _distinct(s, s.item & _has(s.b, BROKEN), s.n)
    # A text may hold the mark itself.
    lines = [[int(x) if x.isdigit() else None for x in (w[1:] + ":").split(":")[:2]] for w in text.of(s.word[rows])]
    return {"file": s.file[rows], "n": s.n[rows], "line_start": [a for a, _ in lines], "line_end": [b for _, b in lines]}


def _links(s: Columns, text: _Text) -> dict:
    rows = _distinct(s, s.item & _has(s.b, LINK), s.n)
    parts = [(w[1:] + 3 * "\u0001").split("\u0001") for w in text.of(s.word[rows])]
    owner, name, spec, target = ([x[i] for x in parts] for i in range(4))
    return {"file": s.file[rows], "n": s.n[rows], "name": name, "text": spec, "owner": owner, "symbol": target}


def _batch(columns: dict, schema: pa.Schema, batch: pa.RecordBatch, fact: str | None = None) -> pa.RecordBatch:
    file = columns.pop("file")
    given = {**columns, **{x: batch.column(x).take(pa.array(file)) for x in ("project", "file_path")}}
    if fact:
        given["fact"] = [fact] * len(file)
    arrays = [pa.nulls(len(file), f.type) if f.name not in given else given[f.name].cast(f.type) if isinstance(given[f.name], pa.Array) else pa.array(given[f.name]).cast(f.type)
              if isinstance(given[f.name], np.ndarray) else pa.array(given[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``SLICE_TOKENS`` tokens."""
    for batch in batches:
        copies = batch.column("copies")
        each = pc.list_value_length(copies.flatten().field("tokens").field("t")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.concatenate([[0], each]))[np.cumsum(copies.value_lengths().to_numpy(zero_copy_only=False))]
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_TOKENS)), at + 1)
            yield batch.slice(at, to - at)
            at = to


def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All facts of files (project, file_path, content, copies)."""
    for batch in slices(batches):
        c, s = shapes(batch.column("copies"))
        text = _Text(s, [None if x is None else x.decode("utf-8", "replace") for x in batch.column("content").cast(pa.large_binary()).to_pylist()])
        kinds: dict[str, Callable] = {"call": _calls, "prop": _props, "declarator": _declarators, "cap": _caps, "decorator": _decorators, "method": _methods,
                                      "bad": _broken, "link": _links}
        for fact, rows in [*((fact, kind(s, text)) for fact, kind in kinds.items()), *_symbols(c, text)]:
            if len(rows["file"]):
                yield _batch(rows, FACTS, batch, fact)


# --- plain views -------------------------------------------------------------------------------

TOKENS = pa.schema([("project", pa.string()), ("file_path", pa.string()), ("n", pa.int32()), ("t", pa.string()), ("pos", pa.int32()), ("line", pa.int32()), ("lvl", pa.int32())])
TOKENS_SQL = "project string, file_path string, n int, t string, pos int, line int, lvl int"
BRACKETS = pa.schema([("project", pa.string()), ("file_path", pa.string()), ("bracket", pa.string()), ("open_n", pa.int32()), ("close_n", pa.int32()), ("lvl", pa.int32())])
BRACKETS_SQL = "project string, file_path string, bracket string, open_n int, close_n int, lvl int"
CALLS = pa.schema([("project", pa.string()), ("file_path", pa.string()), ("open_n", pa.int32()), ("close_n", pa.int32()), ("name", pa.string()), ("names", pa.list_(pa.string())),
                   ("start", pa.int32()), ("stop", pa.int32()), ("line", pa.int32())])
CALLS_SQL = "project string, file_path string, open_n int, close_n int, name string, names array<string>, start int, stop int, line int"


def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens with their places."""
    for batch in slices(batches):
        c = numbered(batch.column("copies"), lambda w: _TOKEN_BITS.get(w, 0))
        known = pa.array(["}" if w == TEMPLATE_CLOSE else w for w in c.known], pa.string())
        rows = np.flatnonzero(~_has(c.b, "end"))
        yield _batch({"file": c.file[rows], "t": known.take(pa.array(c.word[rows])), **{x: getattr(c, x)[rows] for x in ("n", "pos", "line", "lvl")}}, TOKENS, batch)


def all_brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matching bracket pairs."""
    for batch in slices(batches):
        _, s = shapes(batch.column("copies"))
        rows = np.flatnonzero(s.item & s.closes)
        opening = {TEMPLATE_CLOSE: TEMPLATE_OPEN, ")": "(", "]": "[", "}": "{"}
        o = s.open_item[rows]
        yield _batch({"file": s.file[rows], "bracket": [opening[s.known[w]] for w in s.word[rows].tolist()], "open_n": _shown(s.n[o], o >= 0),
                      "close_n": s.n[rows], "lvl": s.lvl[rows]}, BRACKETS, batch)


def all_calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every member call with the names of its chain prefix."""
    for batch in slices(batches):
        _, s = shapes(batch.column("copies"))
        rows = np.flatnonzero(s.is_call)
        o, head = s.open_item[rows], s.head[rows]
        name = _Text(s, []).label(s.label[o])
        yield _batch({"file": s.file[rows], "open_n": s.n[o], "close_n": s.n[rows], "name": name, "names": _chains(s.file[rows], s.level[rows], s.chain[rows], s.n[rows], name, None),
                      "start": _shown(s.head_pos[head], head >= 0), "stop": s.pos[rows] + 1, "line": s.line[rows]}, CALLS, batch)
