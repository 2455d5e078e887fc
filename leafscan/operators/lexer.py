"""Lexing of JS/TS with modes: what a character means depends on what is open around it.

Code inside ``${...}`` is code at any depth, the text of a template or of markup is none, and ``<...>`` behind a name is a list of type arguments if it
closes before ``(``. That is a stack, which no pattern and no running window can hold, so this one step is an Arrow function over batches of files; all
that follows works on the tokens as rows. Time and memory grow with the text of a file.

Brackets that do not balance cost the statement they stand in and nothing else (``islands``): an opening one is given up at the next ``;``, statement
keyword or closing brace that cannot stand inside it, or, if the file ends before, at the next declaration at the start of a line; a closing one
without its partner is passed over. Tokens of a given-up statement are left out and its lines are told in a token of kind ``BROKEN``.

Round brackets that hold nothing but a chain ending in a call, and stand before a ``.``, mean nothing: they are left out, so the chain goes on, and the
token behind them tells how far back it began (``wrap``: characters and line breaks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import sys
from functools import lru_cache
from operator import add, sub
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from .modules import links_in
from .scopes import local_calls

# --- Fixed values: lexical patterns ----------------------------------------------------------
BLANKS = r"[ \t\n\x0b\f\r]"
NAME = r"[\p{L}_$][\p{L}\p{Nd}_$]*+"
STRING = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
COMMENT = r"//[^\n]*+|/\*[\s\S]*?\*/"
# A "!" before a member access or index asserts a value.
ASSERTED = rf"(?<=[\p{{L}}\p{{Nd}}_$)\]])!(?={BLANKS}*+(?:\.(?!\.)|\?\.|\[))"
REGEX = r"/(?![*/>])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[\p{L}]*+"
OPERATOR = r"=>|\?\.|\?\?|\.\.\.|\*\*|\+\+|--|&&|\|\||[-+*/%&|^<>=!]=++"
# Groups: 1 name, 2 anything plain, 3 opening and 4 closing bracket, 5 ";", 6 "`", 7 "/" or "/=", 8 "<".
CODE = rf"(?:{BLANKS}++|{COMMENT}|{ASSERTED})*+(?:({NAME})|({STRING}|[0-9][A-Za-z0-9_.]*+)|([(\[{{])|([)\]}}])|(;)|(`)|(/=++|/)|(<(?!=))|({OPERATOR}|[\s\S]))"
PLAIN_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+`"
TEMPLATE_TEXT = r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+"
TYPE = rf"{BLANKS}++|{COMMENT}|{NAME}|{STRING}|{PLAIN_TEMPLATE}|[0-9][\w.]*+|=>|\.\.\.|&(?!&)|\|(?!\|)|-(?=[0-9?r])|[.,?:;(){{}}<>\[\]]"
TAG_START = rf"<({NAME}(?:[.:-]{NAME})*+)?(?=[\s/>])"
TAG = rf"{BLANKS}*+(?:({NAME}(?:[.:-]{NAME})*+)|(\"[^\"]*+\"|'[^']*+')|(\{{)|(/>)|(>)|(=))"
CLOSING_TAG = rf"</{BLANKS}*+({NAME}(?:[.:-]{NAME})*+)?{BLANKS}*+>"
# What stands before a regular expression rather than a division.
REGEX_AFTER = frozenset("=(,:[!&|?{};~^%*")
REGEX_WORDS = frozenset("return typeof case in of void throw await yield else do delete instanceof".split())
MARKUP_AFTER = frozenset(["(", ",", "=", "=>", "return", "?", ":", "&&", "||", "??", "[", "{", "default", "yield"])
# Statements that cannot stand inside round or square brackets, and declarations of a file.
STATEMENT_WORDS = frozenset("const var return throw try switch while if for export break continue".split())
# What can stand before round brackets that only group, and names that do not begin a chain of calls.
BEFORE_GROUP = frozenset("( [ { , ; : ? = => == === != !== < > <= >= && || ?? ! + - / % += -= ??= ||= &&= ... ${ return await typeof void throw case in of instanceof yield else do default".split())
NO_CHAIN_START = frozenset("new await typeof void delete yield function class async".split())
DECLARATION_WORDS = frozenset("export import function class const let var interface type enum abstract declare async".split())
# --- End of fixed values ---------------------------------------------------------------------

TEMPLATE_OPEN = "${"
TEMPLATE_CLOSE = "\ue07d"  # stands for the "}" that ends an expression in a template
LINK = "\ue0c1"  # followed by the parts of a link between modules, U+0001 between them
BROKEN = "\ue0ba"  # followed by the first and last line of a given-up statement

# This one module travels with its functions: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])



def _ranges(kind: str) -> str:
    """The characters below U+10000 that ``regex`` counts as ``kind``, as ranges of a character class."""
    found = [ord(c) for c in regex.findall(kind, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))]
    starts = [c for b, c in zip([-1, *found], found) if c != b + 1]
    ends = [b for b, c in zip(found, [*found[1:], -1]) if c != b + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


_CODE, _TYPE, _TAG = (regex.compile(x).match for x in (CODE, TYPE, TAG))
# The same for texts of ASCII characters alone and of characters below U+10000, by the standard module, which is faster and is told all letters and digits.
_ASCII_CODE = re.compile(CODE.replace(r"\p{L}", "A-Za-z").replace(r"\p{Nd}", "0-9")).match
_PLANE_CODE = re.compile(CODE.replace(r"\p{L}", _ranges(r"\p{L}")).replace(r"\p{Nd}", _ranges(r"\p{Nd}"))).match
_REGEX, _PLAIN, _TEXT, _TAG_START, _CLOSING = (regex.compile(x).match for x in (REGEX, PLAIN_TEMPLATE, TEMPLATE_TEXT, TAG_START, CLOSING_TAG))
_CALLED = regex.compile(rf"{BLANKS}*+\(").match
_GROUP_GOES_ON = regex.compile(rf"(?:{BLANKS}++|{COMMENT})*+\.(?!\.)").match
_MEMBER = regex.compile(r"\.\p{L}").match
_PAIR = {")": "(", "]": "[", "}": "{"}


def type_arguments(text: str, at: int) -> int | None:
    """End of a list of type arguments that opens at ``at``, if brackets of all kinds close in order and nothing but types stands between."""
    open_, at = ["<"], at + 1
    while m := _TYPE(text, at):
        t, at = m[0], m.end()
        if t in ("(", "[", "{", "<"):
            open_.append(t)
        elif t in (")", "]", "}", ">"):
            if open_.pop() != ("<" if t == ">" else _PAIR[t]):
                return None
            if not open_:
                return at
        elif t == ";" and open_[-1] != "{":
            return None
    return None


class _Open:
    """Something open: a bracket, an expression in a template or in markup, a tag or an element."""

    __slots__ = ("kind", "tokens", "start", "broken", "at", "header", "braces")

    def __init__(self, kind: str, tokens: int, at: int = 0, header: bool = False):
        self.kind, self.tokens, self.at, self.header = kind, tokens, at, header
        self.start, self.broken = tokens + 1, False  # of the statement that runs inside it
        self.braces = kind not in "(["


class Lexer:
    """Tokens of one text; ``islands``: declarations at the start of a line end whatever is open."""

    def __init__(self, text: str, islands: bool = False):
        self.text, self.islands = text, islands
        self.read = _ASCII_CODE if text.isascii() else _PLANE_CODE if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else _CODE
        self.tokens: list[str] = []
        self.starts: list[int] = []
        self.base = _Open("", -1)
        self.open: list[_Open] = []
        self.lost: list[tuple[int, int]] = []  # tokens of given-up statements
        self.wraps: dict[int, tuple[int, int]] = {}  # round brackets without meaning: the closing one of an opening one, and the outermost opening one
        self.plain: set[int] = set()  # places where a backtick or "<" turned out to open nothing
        self.closing: dict[int, int] = {}  # token that closes the round or square bracket at a token
        self._closings: dict[str, int] = {}
        self.unclosed = False

    def run(self) -> Lexer:
        at, mode = 0, self._code
        while mode is not None:
            at, mode = mode(at)
        return self

    # -- what is open ---------------------------------------------------------------------------
    def _frame(self) -> _Open:
        return next((o for o in reversed(self.open) if o.braces), self.base)

    def _ends(self, frame: _Open, end: int) -> None:
        """The running statement of a frame ends before token ``end``."""
        if frame.broken and end > frame.start:
            self.lost.append((frame.start, end))
        frame.broken, frame.start = False, end

    def _give_up(self) -> None:
        """Round and square brackets above the innermost braces are not going to be closed."""
        self._frame().broken = True
        while self.open and not self.open[-1].braces:
            self.open.pop()

    def _back(self, o: _Open) -> tuple[int, Callable]:
        """Forget what has been read since ``o`` was opened: it never closes, so it opened nothing."""
        del self.open[self.open.index(o):], self.tokens[o.tokens:], self.starts[o.tokens:]
        self.lost = [x for x in self.lost if x[1] <= o.tokens]
        self.wraps = {a: x for a, x in self.wraps.items() if x[0] < o.tokens}
        self.plain.add(o.at)
        return o.at, self._code

    def _wrapped(self, a: int) -> None:
        """Note the brackets from token ``a`` to the next one if they hold a chain that ends in a call, or only brackets that do."""
        tokens, first, b = self.tokens, a, len(self.tokens)
        pairs = [(a, b)]
        while b - a > 1 and tokens[a + 1] == "(" and self.closing.get(a + 1) == b - 1:
            a, b = a + 1, b - 1
            pairs.append((a, b))
        k = a + 1
        if k in self.wraps:
            k = self.wraps[k][0]
        elif k == b or not (tokens[k][0].isalpha() or tokens[k][0] in "_$") or tokens[k] in NO_CHAIN_START:
            return
        k += 1
        while k < b:
            if tokens[k] == "." and k + 1 < b:
                k += 2
            elif tokens[k] in ("(", "["):
                k = self.closing.get(k, b) + 1
            else:
                return
        if k == b and tokens[b - 1] == ")":
            self.wraps |= {x: (y, first) for x, y in pairs}

    def _say(self, token: str, at: int) -> None:
        self.tokens.append(token)
        self.starts.append(at)

    def _finish(self, at: int) -> tuple[int, Callable | None]:
        for o in self.open:
            if o.kind in ("`", "<", "tag"):
                return self._back(o)
        if self.open:
            self.unclosed = any(o.kind == "{" for o in self.open)
            self.base.broken = True
            self.open.clear()
        self._ends(self.base, len(self.tokens))
        return at, None

    # -- modes ----------------------------------------------------------------------------------
    def _code(self, at: int) -> tuple[int, Callable | None]:
        text, tokens, starts, open_ = self.text, self.tokens, self.starts, self.open
        read = self.read
        while m := read(text, at):
            kind = m.lastindex
            s, at = m.span(kind)
            t = text[s:at]
            if kind == 1:
                if (t in STATEMENT_WORDS and open_ and not open_[-1].braces and not open_[-1].header and tokens[-1] != "."
                        and "\n" in text[starts[-1]:s] and not text.startswith(":", at)):
                    self._give_up()
                    self._ends(self._frame(), len(tokens))
                elif self.islands and open_ and (s == 0 or text[s - 1] == "\n") and t in DECLARATION_WORDS and tokens[-1] != ".":
                    self.base.broken = True
                    open_.clear()
                    self._ends(self.base, len(tokens))
            elif kind == 3:
                open_.append(_Open(t, len(tokens), header=bool(tokens) and t == "(" and (tokens[-1] == "for" or tokens[-2:] == ["for", "await"])))
            elif kind == 4:
                if not open_ or open_[-1].kind != _PAIR[t]:
                    after = self._unpaired(t, s)
                    if after is not None:
                        return after(at)
                    continue
                o = open_.pop()
                if t != "}":
                    self.closing[o.tokens] = len(tokens)
                if t == ")" and (not o.tokens or tokens[o.tokens - 1] in BEFORE_GROUP) and not o.header and _GROUP_GOES_ON(text, at):
                    self._wrapped(o.tokens)
                if t == "}":
                    self._ends(o, len(tokens))
                    if not open_ or open_[-1].braces:
                        self._say(t, s)
                        self._ends(self._frame(), len(tokens))
                        continue
            elif kind == 5:
                if open_ and not open_[-1].braces and not open_[-1].header:
                    self._give_up()
                if not open_ or open_[-1].braces:
                    self._say(t, s)
                    self._ends(self._frame(), len(tokens))
                    continue
            elif kind == 6 and s not in self.plain:
                if whole := _PLAIN(text, s):
                    t, at = whole[0], whole.end()
                else:
                    open_.append(_Open("`", len(tokens), s))
                    self._say("`", s)
                    return at, self._template
            elif kind == 7:
                before = tokens[-1] if tokens else "("
                if literal := _REGEX(text, s):
                    if before[-1] in REGEX_AFTER or before in ("=>", "+", "-") or before in REGEX_WORDS or before == ")" and _MEMBER(text, literal.end()):
                        t, at = literal[0], literal.end()
            elif kind == 8:
                if tokens and s == starts[-1] + len(tokens[-1]) and (tokens[-1][-1].isalnum() or tokens[-1][-1] in "_$"):
                    end = type_arguments(text, s)
                    if end is not None and _CALLED(text, end):
                        at = end
                        continue
                elif tokens and tokens[-1] in MARKUP_AFTER and s not in self.plain and _TAG_START(text, s):
                    return s, self._element
            tokens.append(t)
            starts.append(s)
        return self._finish(at)

    def _unpaired(self, t: str, s: int) -> Callable | None:
        """A closing bracket whose partner is not on top; gives what to do next if code goes on in another mode."""
        open_ = self.open
        if t == "}":
            if not any(o.braces for o in open_):
                self._stray(t, s)
                return None
            if not open_[-1].braces:
                self._give_up()
            o = open_.pop()
            self._ends(o, len(self.tokens))
            if o.kind == TEMPLATE_OPEN:
                self._say(TEMPLATE_CLOSE, s)
                return self._template
            self._say(t, s)
            if o.kind == "children":
                return self._children
            if o.kind == "attribute":
                return self._attributes
            if not open_ or open_[-1].braces:
                self._ends(self._frame(), len(self.tokens))
            return None
        inner = next((k for k in range(len(open_) - 1, -1, -1) if open_[k].braces or open_[k].kind == _PAIR[t]), -1)
        if inner < 0 or open_[inner].braces:
            self._stray(t, s)
            return None
        self._frame().broken = True
        del open_[inner:]
        self._say(t, s)
        return None

    def _stray(self, t: str, s: int) -> None:
        self._say(t, s)
        self.lost.append((len(self.tokens) - 1, len(self.tokens)))

    def _template(self, at: int) -> tuple[int, Callable | None]:
        end = _TEXT(self.text, at).end()
        if self.text.startswith("`", end):
            self._say("`", end)
            self.open.pop()
            return end + 1, self._code
        if not self.text.startswith(TEMPLATE_OPEN, end):
            return self._finish(end)
        self.open.append(_Open(TEMPLATE_OPEN, len(self.tokens)))
        self._say(TEMPLATE_OPEN, end)
        return end + 2, self._code

    def _element(self, at: int) -> tuple[int, Callable | None]:
        m = _TAG_START(self.text, at)
        self.open.append(_Open("tag", len(self.tokens), at))
        self._say("<", at)
        if m[1]:
            self._say(m[1], at + 1)
        return m.end(), self._attributes

    def _attributes(self, at: int) -> tuple[int, Callable | None]:
        while m := _TAG(self.text, at):
            kind = m.lastindex
            s, at = m.start(kind), m.end()
            if kind == 4:
                self._say("/", s)
                self._say(">", s + 1)
                self.open.pop()
                return at, self._behind_element()
            self._say(m[kind], s)
            if kind == 3:
                self.open.append(_Open("attribute", len(self.tokens) - 1))
                return at, self._code
            if kind == 5:
                tag = self.open[-1]
                name = self.tokens[tag.tokens + 1]
                if self._last_closing("" if name == ">" else name) < at:
                    return self._back(self._outer_element())
                tag.kind = "<"
                return at, self._children
        return self._back(self._outer_element())

    def _outer_element(self) -> _Open:
        """The outermost of the elements that directly hold the innermost one."""
        k = len(self.open) - 1
        while k > 0 and self.open[k - 1].kind == "<":
            k -= 1
        return self.open[k]

    def _last_closing(self, name: str) -> int:
        if name not in self._closings:
            self._closings[name] = self.text.rfind("</" + name)
        return self._closings[name]

    def _behind_element(self) -> Callable:
        return self._children if self.open and self.open[-1].kind == "<" else self._code

    def _children(self, at: int) -> tuple[int, Callable | None]:
        text = self.text
        while True:
            ends = [x for x in (text.find("<", at), text.find("{", at)) if x >= 0]
            if not ends:
                return self._finish(len(text))
            at = min(ends)
            if text[at] == "{":
                self.open.append(_Open("children", len(self.tokens)))
                self._say("{", at)
                return at + 1, self._code
            if m := _CLOSING(text, at):
                self._say("<", at)
                self._say("/", at + 1)
                if m[1]:
                    self._say(m[1], m.start(1))
                self._say(">", m.end() - 1)
                self.open.pop()
                return m.end(), self._behind_element()
            if _TAG_START(text, at):
                return self._element(at)
            at += 1


def lex(text: str, every: bool = False, groups: bool = False) -> tuple[list[str], list[int], list[int], dict[int, tuple[int, int]]]:
    """Tokens with the characters and the line breaks of the gap before each, and by token the ``wrap`` before it.

    ``every`` keeps the tokens of broken statements and all brackets, ``groups`` all brackets.
    """
    found = Lexer(text).run()
    if found.unclosed:
        again = Lexer(text, islands=True).run()
        found = again if sum(b - a for a, b in again.lost) < sum(b - a for a, b in found.lost) else found
    tokens, starts = found.tokens, found.starts
    out: list[str] = []
    gaps: list[int] = []
    lines: list[int] = []
    end, broken_ones = 0, [] if every else sorted(found.lost)
    wraps = {} if every or groups else found.wraps
    if not broken_ones and not wraps:
        ends = [0, *map(add, starts, map(len, tokens))]
        more = [""] if every else ["", *(LINK + "\u0001".join(link) for link in links_in(tokens))]
        none = [0] * len(more)
        breaks = [text.count("\n", e, s) if s > e else 0 for e, s in zip(ends, starts)] if "\n" in text else [0] * len(tokens)
        return tokens + more, [*map(sub, starts, ends), *none], breaks + none, {}
    behind = {b + 1: first for a, (b, first) in wraps.items() if a == first}
    skip = sorted([*broken_ones, *((x, x + 1) for a, (b, _) in wraps.items() for x in (a, b))])
    back: dict[int, tuple[int, int]] = {}
    k = 0
    for a, b in [*skip, (len(tokens), len(tokens))]:
        for i, t, s in zip(range(k, a), tokens[k:a], starts[k:a]):
            if i in behind:
                back[len(out)] = s - starts[behind[i]], text.count("\n", starts[behind[i]], s)
            out.append(t)
            gaps.append(s - end)
            lines.append(text.count("\n", end, s) if s > end else 0)
            end = s + len(t)
        k = max(k, b)
    broken = [(text.count("\n", 0, starts[a]) + 1, text.count("\n", 0, starts[b - 1] + len(tokens[b - 1])) + 1) for a, b in broken_ones]
    more = ["", *(f"{BROKEN}{a}:{b}" for a, b in broken)]
    if not every:
        more += [LINK + "\u0001".join(link) for link in links_in(out)]
    return out + more, gaps + [0] * len(more), lines + [0] * len(more), back


def _texts(contents: pa.Array) -> Iterator[str]:
    for raw in contents.cast(pa.large_binary()):
        yield (raw.as_py() or b"").decode("utf-8", "replace")


def _tokens_of(every: bool = False, groups: bool = False) -> Callable:
    def run(contents: pa.Array) -> pa.Array:
        tokens: list[str] = []
        gaps: list[int] = []
        lines: list[int] = []
        ends, local, wraps = [0], [], {}
        for text in _texts(contents):
            t, g, n, back = lex(text, every, groups)
            if back:
                wraps |= {ends[-1] + k: (chars << 32) + breaks for k, (chars, breaks) in back.items()}
            if not every:
                local += [ends[-1] + k for k in local_calls(t)]
            tokens += t
            gaps += g
            lines += n
            ends.append(len(tokens))
        marks = np.zeros(len(tokens), bool)
        marks[local] = True
        wrap = np.zeros(len(tokens), np.int64)
        wrap[list(wraps)] = list(wraps.values())
        columns = {"t": pa.array(tokens, pa.string()), "gap": pa.array(np.array(gaps, np.int32)), "lines": pa.array(np.array(lines, np.int32)), "local": pa.array(marks), "wrap": pa.array(wrap)}
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in columns.values()], list(columns))

    return run


# Text that is lexed at a time where its tokens do not leave the worker; a file is not cut.
SLICE_BYTES = 1 << 20


def over_texts(of_batches: Callable, kept: str = "") -> Callable:
    """``of_batches`` (see ``shapes``) over files (project, file_path, texts), each lexed here: its tokens are neither exchanged nor sent to the JVM.

    ``kept`` is ``every`` or ``groups`` (see ``lex``).
    """
    run = _tokens_of(kept == "every", kept == "groups")

    def lexed_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("texts")
            sizes = pc.fill_null(pc.binary_length(texts.flatten().field("content")), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))))
            ends, at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[offsets[1:]], 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)), at + 1)
                contents = texts.slice(at, to - at).flatten().field("content")
                told = pa.array(np.ones(len(contents), bool))
                copies = pa.StructArray.from_arrays([told, told, run(contents)], ["deep", "decorated", "tokens"])
                copies = pa.ListArray.from_arrays(pa.array(offsets[at:to + 1] - offsets[at], pa.int32()), copies)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(at, to - at) for x in ("project", "file_path")), copies], ["project", "file_path", "copies"])
                at = to

    return lambda batches: of_batches(lexed_slices(batches))


def _joined(contents: pa.Array) -> pa.Array:
    between = "\u0001"
    found = [between * 2] * len(contents)  # most are null: these texts have no word that is looked for
    rows = np.flatnonzero(contents.is_valid().to_numpy(zero_copy_only=False)).tolist()
    for k, text in zip(rows, _texts(contents.drop_null())):
        found[k] = between + between.join(Lexer(text).run().tokens) + between
    return pa.array(found, pa.string())


@lru_cache
def _function(name: str) -> Callable:
    if name == "joined":
        return F.arrow_udf(_joined, "string")
    return F.arrow_udf(_tokens_of(), "struct<t:array<string>,gap:array<int>,lines:array<int>,local:array<boolean>,wrap:array<bigint>>")


def lexed(content: Column) -> Column:
    """Tokens of a text as arrays side by side, the last token empty, then one for each broken statement and each link between modules.

    ``gap`` and ``lines``: characters and line breaks before a token; ``local``: it opens a call of a name that an inner scope binds; ``wrap``: 2^32 times
    the characters plus the line breaks since the start of the brackets left out before it, or 0.
    """
    return _function("lexed")(content)


def joined(content: Column) -> Column:
    """All tokens of a text with U+0001 around each."""
    return _function("joined")(content)
