"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental byte-to-text machine.

Why a bounded lookahead is enough. Compare the merges of a stretch with those of the same stretch and more text behind it. At first they agree
up to the end of the stretch. The border of agreement moves left only when a merge ``(t, y)`` of the one is missing in the other, where ``t`` is
the last token they share; it then stands before ``t``. The next such merge ``(t', y')`` comes later in the merge list, and ``y'`` begins with
``t``. So the border moves at most by the heaviest chain of merges with rising ranks in which each right part begins with the left part before,
weighing ``len(t)``; ``lookahead`` finds it in one pass over the list. Tokens that end that far before the end of the buffer never change: they
are emitted and dropped, as merges never cross a border of final tokens. Buffer and state stay constant, however long a word is.

Every piece of the vocabulary's split goes through the transducer; where a piece ends, what has not been emitted is decided. Distinct stretches of text
are encoded once per worker (see ``subwords``), each as a stream of blocks. Null texts are empty; empty tables give empty results; rows that repeat are encoded each; special
tokens in a text are their ids, as in the tokenizers library; other columns are not looked at. Nothing is exchanged between rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leafscan.llm import common as c, subwords

BLOCK_CHARS = 1 << 16
# Fixed value: the split of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols behind a token that decide it for good: the heaviest chain of merges described above."""
    best: dict[str, int] = {}
    most = 0
    for left, right in merges:
        reach = len(left) + max((best[right[:k]] for k in range(1, len(right) + 1) if right[:k] in best), default=0)
        best[left] = max(best.get(left, 0), reach)
        most = max(most, reach)
    return most


class Transducer:
    """Ids of one piece of the split, pushed symbol by symbol; what is stable comes out at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], block: int | None = None):
        self.symbols, self.merges = vocab, merges
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.lengths = {i: len(s) for s, i in vocab.items()}
        self.reach = lookahead(merges)
        # Symbols that are held before the stable ones are taken out: each is then merged a bounded number of times.
        self.block = max(block or 0, 2 * self.reach + 2 * max(self.lengths.values()))

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a bounded stretch: always the best-ranked pair, the leftmost of equal ones."""
        n, get = len(ids), self.ranks.get
        heap = [(found[0], k) for k, found in enumerate(map(get, zip(ids, ids[1:]))) if found is not None]
        if not heap:
            return ids
        heapify(heap)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        while heap:
            rank, k = heappop(heap)
            j = after[k]
            if j < 0 or (found := get((ids[k], ids[j]))) is None or found[0] != rank:
                continue  # one of the two has been merged since
            ids[k], ids[j] = found[1], -1
            after[k], after[j], i = after[j], -1, before[k]
            if (j := after[k]) >= 0:
                before[j] = k
                if (found := get((ids[k], ids[j]))) is not None:
                    heappush(heap, (found[0], k))
            if i >= 0 and (found := get((ids[i], ids[k]))) is not None:
                heappush(heap, (found[0], i))
        return [i for i in ids if i >= 0]

    def stable(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """(final ids, symbols whose tokens may still change)."""
        if len(symbols) < self.block:
            return [], symbols
        out, end, keep = [], 0, len(symbols) - self.reach
        for token in self.merge(list(symbols)):
            if end + self.lengths[token] > keep:
                break
            end += self.lengths[token]
            out.append(token)
        return out, symbols[end:]

    def piece(self, symbols: list[int]) -> list[int]:
        """Ids of a whole piece."""
        out: list[int] = []
        buffer: list[int] = []
        for k in range(0, len(symbols), self.block):
            done, buffer = self.stable(buffer + symbols[k:k + self.block])
            out += done
        return out + self.merge(buffer)


class StreamEncoder(subwords.Encoder):
    """Like the library's encoder of the byte-level vocabulary, every merge made by the transducer."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges)
        self.split = regex.compile(SPLIT)
        self.byte_ids = [model["vocab"][self.letters[b]] for b in range(256)]
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_split = regex.compile("|".join(map(regex.escape, self.specials)))
        self.bytes_of = {i: bytes(ord_of[ch] for ch in s) for ord_of in [{v: k for k, v in self.letters.items()}] for s, i in model["vocab"].items() if all(ch in ord_of for ch in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}

    def _merge(self, piece: str) -> list[int]:
        return self.transducer.piece([self.byte_ids[b] for b in piece.encode()])

    def _whole(self, text: str) -> bytes:
        ids = array(self.code)
        for part in self.stream(text[k:k + BLOCK_CHARS] for k in range(0, max(len(text), 1), BLOCK_CHARS)):
            ids.extend(part)
        return ids.tobytes()

    def stream(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that comes in blocks; memory is bounded by a block, whatever the text."""
        longest = max(map(len, self.specials), default=1)
        rest, open_run, buffer = "", None, []
        for text, last in _with_last(blocks):
            rest += text
            while True:
                found = self.special_split.search(rest)
                limit = found.start() if found else len(rest) if last else max(0, len(rest) - longest)
                whole = bool(found) or last
                segment, rest = rest[:limit], rest[limit:]
                ids, tail, open_run, buffer = self._segment(segment, whole, open_run, buffer)
                rest = tail + rest
                if ids:
                    yield ids
                if not found:
                    break
                yield [self.specials[found.group()]]
                rest = rest[len(found.group()):]

    def _segment(self, text: str, whole: bool, run, buffer: list[int]):
        """(ids, text not yet decided, open run, its buffer) of the next part of a text; ``whole``: nothing of it follows."""
        out: list[int] = []
        at = 0
        if run is not None:  # a run of one kind that the block before has left open
            match = run.match(text)
            at = match.end() if match else 0
            done, buffer = self.transducer.stable(buffer + [self.byte_ids[b] for b in text[:at].encode()])
            out += done
            if at < len(text) or whole:
                out += self.transducer.merge(buffer)
                run, buffer = None, []
            else:
                return out, "", run, buffer
        safe = len(text) if whole else len(text) - 3
        while at < len(text):
            match = self.split.match(text, at)
            if match.end() > safe:
                piece = text[at:]
                if not whole and len(piece) >= BLOCK_CHARS // 4:
                    start = 1 if piece[0] == " " else 0
                    run = next((r for r in _RUNS if (m := r.match(piece, start)) and m.end() == len(piece)), None)
                    if run is not None:
                        done, buffer = self.transducer.stable([self.byte_ids[b] for b in piece.encode()])
                        return out + done, "", run, buffer
                if not whole:
                    return out, piece, None, []
            out += self._merge(match.group())
            at = match.end()
        return out, "", None, []


def _with_last(blocks: Iterable[str]) -> Iterator[tuple[str, bool]]:
    held = None
    for block in blocks:
        if held is not None:
            yield held, False
        held = block
    yield held or "", True


class Decoder:
    """Text of ids that come in any parts: bytes of a code point are held until it is complete, broken ones become U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out


_WORKERS: dict[str, tuple] = {}


def _worker(path: str) -> tuple[StreamEncoder, Decoder, list[str]]:
    if path not in _WORKERS:
        encoder = StreamEncoder(path)
        decoder = Decoder(encoder.bytes_of)
        _WORKERS[path] = encoder, decoder, [str(i) for i in range(len(decoder.bytes_of))]
    return _WORKERS[path]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each document: number of ids, sha256 of the ids (decimal, with commas) and of the decoded text; with ``with_ids`` both in full."""
    path = vocabulary or subwords.public_path("byte_bpe_50k.json")

    def work(batches):
        encoder, decoder, decimal = _worker(path)
        for batch in c.slices(batches, "text"):
            counts, flat = encoder.encode(batch.column("text"))
            ids_hash, text_hash, lists, texts, at = [], [], [], [], 0
            for n in counts.tolist():
                ids_sum, text_sum, first = hashlib.sha256(), hashlib.sha256(), at
                while at < first + n:
                    part = flat[at:min(at + 65536, first + n)].tolist()
                    ids_sum.update(("," if at > first else "").encode() + ",".join(map(decimal.__getitem__, part)).encode())
                    text = decoder.push(part)
                    text_sum.update(text.encode())
                    at += len(part)
                    if with_ids:
                        texts.append(text)
                last = decoder.finish()
                text_sum.update(last.encode())
                ids_hash.append(ids_sum.hexdigest())
                text_hash.append(text_sum.hexdigest())
                if with_ids:
                    lists.append((flat[first:at].astype(np.int32), "".join(texts) + last))
                    texts = []
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
            if with_ids:
                columns += [pa.array([x for x, _ in lists], pa.list_(pa.int32())), pa.array([x for _, x in lists], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:len(columns)])

    slim = docs.select(c.row_id(id_col).alias("doc_id"), c.text_of(text_col).alias("text"))
    return slim.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
