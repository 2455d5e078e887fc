"""Quality rules, line first: judge every line, remove the failing ones, then judge what a document has lost.

A line is what stands between ``\\n``; a word is ``[^\\x20\\x09-\\x0D]+``. A line with words fails if any of these holds:

* navigation: at least ``min_bars`` separators (``| » › •`` or `` > `` between blanks), one for every four words or more;
* boilerplate: a short line (at most ``notice_words`` words) that has one of the notice phrases (cookies, scripts, all rights reserved ...);
* punctuation: of ``min_words`` words or more, at least a third end in a run of two or more marks (``!!`` ``***`` ``$$$``),
  or no word ends in sentence punctuation and the line is longer than ``bare_words`` words;
* monotony: of ``min_words`` words or more, at least half repeat the word before them.

Lines without words never fail. A document goes if the base rules fail (fewer than 50 words, or more than half of its words in repeated
three-word windows) or if its failing lines hold more than ``max_loss`` of its words.

Null text: no words, so base_failed. Empty tables give empty results; rows that repeat are judged each; other columns are not looked at.
Everything is a function of one row, so nothing is exchanged; a slice of about 1 MB of text is in memory at a time, a longer text whole, and what a
slice has taken goes back to the system before the next one. Only texts that lose lines are made anew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from leafscan.llm import common as c

WORD = r"[^\x20\x09-\x0D]"
SLICE_BYTES = 1 << 20
# Phrases of notices that are not running text, lower case.
NOTICES = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "accept cookies",
           "enable javascript", "javascript is disabled", "click here to", "sign up for our newsletter", "subscribe to our newsletter",
           "log in to your account", "powered by", "skip to content", "back to top", "lorem ipsum")


@dataclass(frozen=True)
class Rules:
    max_loss: float = 0.5
    min_words: int = 4
    bare_words: int = 12
    min_bars: int = 3
    notice_words: int = 30


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LATER = np.zeros(256, bool)
_LATER[128:192] = True  # bytes of a code point after its first


def _repeated_words(offsets: np.ndarray, words: np.ndarray, n_codes: int) -> np.ndarray:
    """For each string the number of words in three-word windows that it has twice or more."""
    if len(words) < 3:
        return np.zeros(len(offsets) - 1, np.int64)
    owner = c.owners(offsets)
    pair, _ = c.codes_of(words[:-1].astype(np.int64) * n_codes + words[1:])
    window, n = c.codes_of(pair[:-1].astype(np.int64) * n_codes + words[2:])
    whole = np.flatnonzero(owner[:-2] == owner[2:])
    group, n = c.codes_of(owner[whole].astype(np.int64) * n + window[whole])
    twice = np.zeros(len(words), bool)
    twice[whole] = np.bincount(group, minlength=n)[group] > 1
    inside = twice.copy()
    inside[1:] |= twice[:-1]
    inside[2:] |= twice[:-2]
    return c.sums_by(offsets, inside)


def _failing_lines(lines: pa.Array, at: np.ndarray, words: pa.Array, codes: np.ndarray, rules: Rules) -> np.ndarray:
    n = np.diff(at)
    count = lambda flags: c.sums_by(at, flags.to_numpy(zero_copy_only=False))
    marks = count(pc.match_substring_regex(words, r"[!?#*$%&~^=_+<>|@]{2}$"))
    ends = count(pc.match_substring_regex(words, r"[.!?:;…。！？؟][\"'”’»)\]]*$"))
    bars = count(pc.match_substring_regex(words, r"^[|»›•>]$"))
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[at[:-1][n > 0]] = False
    same = c.sums_by(at, same)
    notice = pc.match_substring_regex(pc.utf8_lower(lines), "|".join(NOTICES)).to_numpy(zero_copy_only=False)
    long_enough = n >= rules.min_words
    return ((n > 0) & (
        (bars >= rules.min_bars) & (bars * 4 >= n - bars)
        | notice & (n <= rules.notice_words)
        | long_enough & (marks * 3 >= n)
        | long_enough & (ends == 0) & (n > rules.bare_words)
        | long_enough & (same * 2 >= n)))


def judge(texts: pa.Array, rules: Rules = Rules(), clean: bool = True) -> dict[str, np.ndarray | pa.Array]:
    """Counts, verdict and, with ``clean``, cleaned text of each text; ``texts`` is a string array without nulls."""
    offsets, raw = c.utf8_bytes(texts)
    word_at, words = c.words_of(texts)
    codes, n_codes = c.codes_of(words)
    n_words = np.diff(word_at)
    line_at, lines = c.list_parts(pc.split_pattern(texts, "\n"))
    in_line, line_words = c.words_of(lines)
    line_n = np.diff(in_line)
    line_owner = c.owners(line_at)
    line_codes, n_lines = c.codes_of(lines)
    full = np.flatnonzero(line_n > 0)
    group, n_groups = c.codes_of(line_owner[full].astype(np.int64) * max(n_lines, 1) + line_codes[full])
    first = np.full(n_groups, len(full), np.int64)
    np.minimum.at(first, group, np.arange(len(full)))
    again = np.zeros(len(line_n), bool)
    again[full] = np.arange(len(full)) != first[group]
    repeats = _repeated_words(word_at, codes, max(n_codes, 1))
    fails = _failing_lines(lines, in_line, line_words, codes, rules)
    lost = c.sums_by(line_at, np.where(fails, line_n, 0))
    base_failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    kept = ~base_failed & (lost <= rules.max_loss * n_words)
    out = {"n_words": n_words, "word_chars": c.sums_by(offsets, ~_SPACE[raw] & ~_LATER[raw]), "n_symbols": c.sums_by(offsets, _SYMBOL[raw]),
            "n_dup_lines": c.sums_by(line_at, again), "n_repeat_words": repeats, "base_failed": base_failed, "kept": kept,
            "lost_words": lost, "lost_lines": c.sums_by(line_at, fails)}
    if clean:
        changed = np.flatnonzero(lost > 0)
        anew = ["\n".join(lines.slice(line_at[k], line_at[k + 1] - line_at[k]).filter(pa.array(~fails[line_at[k]:line_at[k + 1]])).to_pylist()) for k in changed]
        out["cleaned"] = pc.replace_with_mask(texts, pa.array(lost > 0), pa.array(anew, texts.type)) if len(changed) else texts
    return out


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long, lost_lines long"


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """One row for each document: id, counts, verdict and, with ``with_text``, the text without its failing lines."""
    def work(batches):
        for batch in c.slices(batches, "text", SLICE_BYTES):
            out = judge(batch.column("text"), rules, with_text)
            names = [x.split()[0] for x in COUNTS.split(", ")]
            columns = [batch.column("doc_id"), *(pa.array(out[n]) for n in names)]
            if with_text:
                columns.append(out["cleaned"])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, *["cleaned"] * with_text])
            del out, columns
            c.give_back()

    slim = docs.select(c.row_id(id_col).alias("doc_id"), c.text_of(text_col).alias("text"))
    return slim.mapInArrow(work, f"doc_id long, {COUNTS}" + ", cleaned string" * with_text)


def clean_documents(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The kept documents with all their columns; texts have lost their failing lines, ``size_col`` (if there) is counted anew.

    A null text stays null and its document goes, as it has no words.
    """
    schema, names = docs.schema, docs.columns

    def work(batches):
        for batch in c.slices(batches, text_col, SLICE_BYTES):
            out = judge(batch.column(text_col).fill_null(""), rules)
            kept, cleaned = pa.array(out["kept"]), out["cleaned"]
            columns = {n: batch.column(n) for n in names} | {text_col: cleaned}
            if size_col in columns:
                changed = pa.array(out["lost_words"] > 0)
                columns[size_col] = pc.if_else(changed, pc.utf8_length(cleaned).cast(columns[size_col].type), columns[size_col])
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names).filter(kept)
            del out, columns, cleaned
            c.give_back()

    return docs.mapInArrow(work, schema)
