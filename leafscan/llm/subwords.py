"""Whole texts as ids of a public vocabulary, by the tokenizers library, each distinct stretch of text encoded once per worker.

Both vocabularies split a text before merging, and no split crosses the place before a lone blank or line break. So a text is cut there, the
stretches of a slice of rows are numbered in Arrow, only the distinct ones are looked up or encoded, and the ids of all stretches are put
together with numpy. Texts in which such a cut could change the split (runs of white space, special tokens) are cut more carefully or not at all.
The memory is bounded: two generations of ``keep`` stretches; what falls out is encoded again.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leafscan.llm import common as c

_SPACED = r"[ \n][ \n]|[\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = re.compile("(?<=[^\\s\x1c-\x1f\x85᠎​])(?=[ \n])")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which the split treats apart
_SHORT_OF = "ɐ"  # letters below are single code points in every normal form and letters in every version of Unicode


def public_path(name: str) -> str:
    """Place of a vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """``encode(texts)`` gives (ids of each text, flat ids); equal to the library's encoding of each whole text without special tokens added."""

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.lower = self.tokenizer.normalizer is not None  # the vocabulary that drops white space and case
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = array("H" if self.dtype is np.uint16 else "I").typecode
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.keep, self.new, self.old = keep, {}, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merge(self, piece: str) -> list[int]:
        """Ids of one piece of the split; the byte letters of ASCII marks and letters are these themselves."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        elif piece[0] in " \n":
            piece = self.letters[ord(piece[0])] + piece[1:]
        return [t.id for t in self.model.tokenize(piece)]

    def _stretch(self, unit: str) -> bytes:
        """A plain word with its blank and closing marks goes straight to the library's merges, anything else through all its steps."""
        blank = unit[:1] if unit[:1] in " \n" else ""
        word = unit[len(blank):]
        core = word.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) < _SHORT_OF and "İ" not in core):
            if len(core) < len(word):
                return self._known(blank + core) + self._known(word[len(core):])
            if blank == "\n" and not self.lower:
                return self._known(blank) + self._known(core)
            return array(self.code, self._merge(core.lower() if self.lower else unit)).tobytes()
        if unit == "\n" or word and not core and not blank and not self.lower:
            return array(self.code, self._merge(unit)).tobytes()
        return self._whole(unit)

    def _known(self, unit: str) -> bytes:
        ids = self.new.get(unit) or self.old.get(unit)
        if ids is None:
            ids = self._stretch(unit)
        if len(unit) <= 64:
            self.new[unit] = ids
        return ids

    def _lookup(self, units: list[str]) -> list[bytes]:
        new, old = self.new, self.old
        out = list(map(new.get, units))
        for k, ids in enumerate(out):
            if ids is None:
                unit = units[k]
                ids = old.get(unit)
                if ids is None:
                    ids = self._stretch(unit)
                if len(unit) <= 64:
                    new[unit] = ids
                out[k] = ids
        if len(new) >= self.keep:
            self.old, self.new = new, {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        if self.lower:
            plain = pc.replace_substring(texts, "\n", " ")
        else:
            odd = odd | pc.match_substring_regex(texts, _SPACED).to_numpy(zero_copy_only=False)
            plain = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n")
        offsets, units = c.list_parts(pc.split_pattern(pc.if_else(pa.array(odd), "", plain), " " if self.lower else "\x01"))
        encoded = units.dictionary_encode()
        codes = encoded.indices.to_numpy()
        blobs = self._lookup(encoded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // np.dtype(self.dtype).itemsize
        flat = np.frombuffer(b"".join(blobs), self.dtype)
        sizes = lengths[codes]
        counts = c.sums_by(offsets, sizes)
        ends = np.cumsum(sizes)
        places = np.repeat((np.cumsum(lengths) - lengths)[codes] - (ends - sizes), sizes)
        places += np.arange(len(places))
        ids = flat[places]
        if odd.any():
            ids, counts = self._insert(texts, odd, ids, counts)
        return counts, ids

    def _insert(self, texts: pa.Array, odd: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(counts)
        parts, last, counts = [], 0, counts.copy()
        special = re.compile(self.special)
        for k in np.flatnonzero(odd):
            text = texts[k].as_py()
            whole = self.lower or special.search(text)
            own = np.frombuffer(self._whole(text) if whole else b"".join(self._lookup(_CUT.split(text))), self.dtype)
            parts += [ids[last:ends[k]], own]
            last, counts[k] = ends[k], len(own)
        return np.concatenate([*parts, ids[last:]]), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, keep: int = 300_000) -> Encoder:
    """The worker's encoder of a vocabulary file; it keeps what it has seen from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, keep)
    return _ENCODERS[path]


# Text that is encoded at a time: stretches, codes and places of a slice take some twenty-five times its bytes.
SLICE_BYTES = 2 << 20
# Stretches that such a worker keeps, some 250 bytes each: other steps use it after this one.
KEPT = 100_000


def encoded(batches: Iterator[pa.RecordBatch], path: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids of each text, flat ids) of slices of ``limit`` bytes of ``text``; the memory of each is given back before the next."""
    encode = encoder(path, KEPT).encode
    for batch in c.slices(batches, "text", limit):
        yield batch, *encode(batch.column("text"))
        c.give_back()


def with_end(counts: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text, as unsigned 32-bit ids."""
    out = np.full(len(ids) + len(counts), end, "<u4")
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    out[inner] = ids
    return counts + 1, out
