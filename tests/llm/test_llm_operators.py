"""Each operator against a brute-force version on small tables, with nulls, empty and very long texts, repeats, ties and clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from leafscan.llm import attention_lm, bpe_stream, collision_ann, line_quality, lsh_forest, orc_ids, packing, queries, sharding, subwords, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, kept string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "the", "or", "ti", "on", "sé", "lu", "mi"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    lines = [" ".join(words[i:i + 14]).capitalize() + "." for i in range(0, n, 14)]
    return "\n".join(lines)


def rows_of(texts):
    return [(i, t, "en", "src0", len(t or ""), "x", "y", "z") for i, t in texts]


LONG = prose(99, 60_000)
BASE = prose(1, 200)
TEXTS = [(0, BASE), (1, BASE), (2, BASE + " One more word here."), (3, None), (4, ""), (5, LONG), (6, prose(2, 90)), (None, prose(3, 70)), (7, prose(2, 90)),
         (7, prose(2, 90)), (8, "A | b | c | d | e"), (9, " \n\t x  y\n\n"), (10, "it's <|endoftext|> 12 ²x é"), (11, "short text"), (12, "short text\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def encoded(name, text):
    return subwords.encoder(subwords.public_path(name)).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_units_equal_whole_texts():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        import pyarrow as pa
        texts = [t or "" for _, t in TEXTS] + ["a  b", "x\n\ny", "tab\tq  z", "é x", "İstanbul ΣΑΣ", "\n", " ", "日本語 テスト", "a\x1cb c", "foo...!! bar?"]
        counts, ids = subwords.Encoder(subwords.public_path(name), keep=50).encode(pa.array(texts))
        at = 0
        for text, n in zip(texts, counts):
            assert ids[at:at + n].tolist() == encoded(name, text), text[:40]
            at += n


def test_packing(docs, none):
    out = packing.pack(docs, length=512, with_ids=True).collect()
    assert packing.pack(none).count() == 0
    texts = Counter()
    by_doc, by_sequence = {}, {}
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.sequence_id * 512 + r.offset - r.start, r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for (_, doc_id, n), pieces in by_doc.items():
        ids = [i for _, part in sorted(pieces) for i in part]
        assert len(ids) == n
        texts[(doc_id, tuple(ids))] += 1
    assert texts == Counter((i, (*encoded("word_bpe_49k.json", t), 2)) for i, t in TEXTS)
    last = max(by_sequence)
    assert sorted(by_sequence) == list(range(last + 1))
    for s, pieces in by_sequence.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 512 or s == last


def test_orc_round_trip(spark, docs, none, tmp_path):
    out = sorted(orc_ids.round_trip(docs).collect(), key=lambda r: r.start)
    ids = [[*encoded("byte_bpe_50k.json", t), 2] for _, t in TEXTS]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(x), crc(x)) for (i, _), x in zip(TEXTS, ids))
    assert [r.doc_id for r in out][:1] == [None] and [r.doc_id for r in out][1:] == sorted(i for i, _ in TEXTS if i is not None)
    assert [r.start for r in out] == list(np.cumsum([0] + [r.n_tokens for r in out])[:-1])
    assert orc_ids.round_trip(none).count() == 0
    orc_ids.write_ids(docs, str(tmp_path / "x.orc"))
    found = orc_ids.read_documents(spark, str(tmp_path / "x.orc"), [6])
    assert [r.ids for r in found.collect()] == [ids[6]]
    assert "EqualTo(doc_id,6)]" in found._jdf.queryExecution().toString()


def test_sharding(docs, none):
    out = sharding.shard_documents(docs, 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 24 for k, s in shards.items())
    assert sharding.shard_documents(none).count() == 0


@pytest.mark.parametrize("shards,weights", [(5, None), (23, None), (24, None), (3, [1.0, 0.0, 2.5])])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards, weights):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard_documents(docs, shards, weights=weights).select("doc_id", "shard", "grown_shard").collect()
    share = 1 / (sum(weights or [1.0] * shards) + 1)
    assert len(out) == 6000 and all(r.grown_shard in (r.shard, shards) for r in out)
    assert 0.75 * share < sum(r.grown_shard == shards for r in out) / 6000 < 1.25 * share
    assert sharding.grown_tree(sharding.tree_of(24)) == sharding.tree_of(25)


def test_shards_by_force(spark):
    """The draw recomputed: 64-bit hashes of the key and the child in a chain, the smallest -ln(u) / weight at each level."""
    weights = [1.0, 2.0, 0.0, 1.5, 3.0, 1.0, 0.5, 1.0, 1.0, 2.0, 1.0, 1.0, 4.0, 1.0]
    tree = sharding.tree_of(len(weights), weights=weights)

    def draw(key, level, children):
        def race(child, weight):
            seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            bits = xxhash.xxh64_intdigest(f"{level}/{child}".encode(), seed) >> 11
            return -math.log((bits + 0.5) / 2 ** 53) / weight, child
        return min(race(k, w) for k, w in children if w > 0)[1]

    def by_force(key):
        racks = [(r, rack) for r, region in enumerate(tree) for rack in region]
        first = list(itertools.accumulate((len(rack) for _, rack in racks), initial=0))
        region = draw(key, "region", [(r, sum(map(sum, x))) for r, x in enumerate(tree)])
        rack = draw(key, "rack", [(k, sum(x)) for k, (r, x) in enumerate(racks) if r == region])
        return draw(key, "shard", [(first[rack] + k, w) for k, w in enumerate(racks[rack][1])])

    out = spark.range(-2000, 2000).select("id", sharding.shard_of(F.col("id"), tree).alias("shard")).collect()
    assert all(r.shard == by_force(r.id) for r in out) and len({r.shard for r in out}) == 13


def test_sharding_moves(spark):
    keys = spark.range(40_000).select(sharding.shard_of(F.col("id"), sharding.tree_of(24)).alias("a"), sharding.shard_of(F.col("id"), sharding.tree_of(25)).alias("b"),
                                      sharding.shard_of(F.col("id"), sharding.tree_of(24, weights=[2.0] + [1.0] * 23)).alias("w")).toPandas()
    assert ((keys.a == keys.b) | (keys.b == 24)).all() and 1300 < (keys.b == 24).sum() < 1900
    assert keys.a.value_counts().between(1400, 1950).all() and keys.a.nunique() == 24
    assert 2900 < (keys.w == 0).sum() < 3500
    assert ((keys.a == keys.w) | (keys.w // 12 == 0)).all()  # only into the region whose weight has grown
    slots = sharding.numbered(spark.range(1000).select((F.col("id") % 3 > 0).cast("int").alias("shard"), F.col("id").alias("_row")), "shard", "slot", bucket_rows=50)
    for s, n in ((0, 334), (1, 666)):
        assert sorted(r.slot for r in slots.filter(F.col("shard") == s).collect()) == list(range(n))


def counted(text):
    words, lines = WORD.findall(text), text.split("\n")
    triples = Counter(zip(words, words[1:], words[2:]))
    inside = {k for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    full = [x for x in lines if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(inside), n < 50 or 100 * len(inside) > 50 * n)


def test_line_quality(spark, docs, none):
    more = [(20, "a b c d a b c d " * 30), (21, BASE + "\n" + BASE), (22, "x #### $$ | <b>\nx\nx"), (23, prose(5, 60) + "\n" + "foo | " * 20), (24, " ".join("W%d!!" % i for i in range(80)))]
    table = docs.union(spark.createDataFrame(rows_of(more), DOCS))
    out = line_quality.line_quality(table, with_text=True).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in out) == Counter((i, *counted(t or "")) for i, t in TEXTS + more)
    by = {r.doc_id: r for r in out}
    assert by[0].kept and by[0].cleaned == BASE and not by[24].kept and not by[3].kept
    assert by[23].kept and by[23].cleaned == prose(5, 60) and by[23].lost_lines == 1
    kept = line_quality.clean_documents(table)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    cleaned = {r.doc_id: r for r in kept.collect()}
    assert set(cleaned) == {r.doc_id for r in out if r.kept} and cleaned[23].n_chars == len(prose(5, 60)) and cleaned[0].text == BASE
    assert line_quality.line_quality(none).count() == 0 and line_quality.clean_documents(none).count() == 0


def fails_by_force(line):
    words = WORD.findall(line)
    n, low = len(words), line.lower()
    bars = sum(w in ("|", "»", "›", "•", ">") for w in words)
    marks = sum(bool(re.search(r"[!?#*$%&~^=_+<>|@]{2}\Z", w)) for w in words)
    ends = sum(bool(re.search(r"[.!?:;…。！？؟][\"'”’»)\]]*\Z", w)) for w in words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    return n > 0 and (bars >= 3 and 4 * bars >= n - bars or n <= 30 and any(x in low for x in line_quality.NOTICES)
                      or n >= 4 and (3 * marks >= n or n > 12 and not ends or 2 * same >= n))


def test_line_rules_by_force(spark):
    r = random.Random(8)
    parts = ["ab", "cd", "cd", "ef", "gh.", "ij!", "kl!!", "x$$", "|", "»", "ok?\"", "(no.)", "é…", "Privacy policy", "back to top"]
    lines = ["", " \t", *(" ".join(r.choices(parts, [8, 8, 8, 8, *[r.choice((0, 0.5, 4))] * 11], k=r.randint(1, 34))) for _ in range(1500))]
    lines += [" ".join("k%d" % i for i in range(n)) for n in (3, 4, 12, 13, 14, 40)] + [" ".join("k%d" % i for i in range(40)) + end for end in (".", "…", "?)", ",")]
    table = spark.createDataFrame(rows_of(enumerate(lines)), DOCS)
    out = {x.doc_id: x for x in line_quality.line_quality(table, with_text=True).collect()}
    assert [out[i].lost_lines for i in range(len(lines))] == [int(fails_by_force(x)) for x in lines]
    assert [out[i].lost_words for i in range(len(lines))] == [len(WORD.findall(x)) * fails_by_force(x) for x in lines]
    bare = "\n".join(" ".join(f"tag{k}x{i}" for i in range(20)) for k in range(6))  # long lines of varied words, no punctuation
    table = spark.createDataFrame(rows_of([(0, bare), (1, bare + "\n" + BASE), (2, BASE)]), DOCS)
    got = {x.doc_id: x for x in line_quality.line_quality(table, with_text=True).collect()}
    assert [(got[i].base_failed, got[i].kept, got[i].lost_lines) for i in range(3)] == [(False, False, 6), (False, True, 6), (False, True, 0)]
    assert got[1].cleaned == BASE and {x.doc_id for x in line_quality.clean_documents(table).collect()} == {1, 2}


def test_line_quality_twin(spark, docs, none, tmp_path):
    r = random.Random(4)
    parts = ["ab", "cd", "cd", "gh.", "kl!!", "\t|", "»", "ok?\"", "é…", "Privacy policy", "\r\n", "\n", "\n\n", "\u00a0x", "\x0b", "<b>", "$$", "d\u0301"]
    more = [(100 + k, " ".join(r.choices(parts, k=r.randint(0, 200)))) for k in range(300)] + [(100, "ab " * 60), (100, None)]
    for k, table in enumerate((docs.union(spark.createDataFrame(rows_of(more), DOCS)), none)):
        path = str(tmp_path / str(k))
        table.coalesce(1).write.parquet(path)
        base = duckdb.connect()
        base.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        twin = base.sql(queries.ORACLES["op7_line_quality"])
        out = line_quality.line_quality(spark.read.parquet(path)).select(*twin.columns)
        assert Counter(map(tuple, out.collect())) == Counter(twin.fetchall()) and out.count() == table.count()


def near_by_force(texts):
    sets = {}
    for _, t in texts:
        words = WORD.findall((t or "").lower())
        sets[t or ""] = frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    names, up, links = list(sets), {}, Counter()
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in combinations(names, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            up[find(a)] = find(b)
    ids = {}
    for i, t in texts:
        ids.setdefault(find(t or ""), []).append(i)
    return Counter((i, min((x for x in ids[find(t or "")] if x is not None), default=None), links[t or ""], sum((u or "") == (t or "") for _, u in texts)) for i, t in texts)


def family(n):
    """Copies of one text with a few words changed: near each other to different degrees."""
    r, words, out = random.Random(4), BASE.split(" "), []
    for k in range(n):
        own = list(words)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = f"w{r.randrange(1000)}"
        out.append((100 + k, " ".join(own)))
    return out


@pytest.mark.parametrize("forest", [lsh_forest.Forest(), lsh_forest.Forest(node_rows=16, block_rows=8)])
def test_near_duplicates(spark, forest):
    texts = TEXTS + family(60)
    table = spark.createDataFrame(rows_of(texts), DOCS).repartition(4)
    out = lsh_forest.near_duplicates(table, forest=forest).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in out) == near_by_force(texts)
    kept = lsh_forest.one_of_each(table, forest=forest)
    assert kept.schema == table.schema
    assert kept.count() == len({r[1] for r in near_by_force(texts)})


def test_near_duplicates_empty(none):
    assert lsh_forest.near_duplicates(none).count() == 0 and lsh_forest.one_of_each(none).count() == 0
    f = lsh_forest.Forest()
    assert (f.longest, f.depth) == (6, 4) and 1 - (1 - 0.8 ** 4) ** f.trees >= f.recall > 1 - (1 - 0.8 ** 5) ** f.trees


def test_walk_of_a_trie_connects_what_is_close():
    r = np.random.default_rng(1)
    for trial in range(200):
        base = r.integers(0, 9, (r.integers(1, 4), 24))
        s = base[r.integers(0, len(base), 30)].astype(np.uint16)
        s[r.random(s.shape) < 0.06] = 9
        labels = s[:, :6]
        edges, used = lsh_forest.walk(s, labels, 3, 0.8)
        up = {}
        find = lambda x: x if up.get(x, x) == x else find(up[x])
        for x, y in combinations(range(30), 2):
            if (labels[x, :3] == labels[y, :3]).all() and (s[x] == s[y]).mean() >= 0.8:
                up[find(x)] = find(y)
        want = {frozenset(y for y in range(30) if find(y) == find(x)) for x in range(30)}
        up = {}
        for x, y in edges:
            assert find(x) != find(y)  # a forest
            up[find(x)] = find(y)
        assert {frozenset(y for y in range(30) if find(y) == find(x)) for x in range(30)} == want and 3 <= used <= 6
    copies = np.repeat(r.integers(0, 99, (1, 24)), 50, 0).astype(np.uint16)
    assert lsh_forest.walk(copies, copies[:, :6], 3, 0.8)[1] == 6  # near copies need the longest prefix only


def test_bpe_lookahead_of_small_vocabularies():
    r = random.Random(0)
    for trial in range(60):
        vocab, merges = {"a": 0, "b": 1}, []
        while len(merges) < 8:
            x, y = r.choice(list(vocab)), r.choice(list(vocab))
            if x + y not in vocab:
                merges.append((x, y))
                vocab[x + y] = len(vocab)
        t = bpe_stream.Transducer(vocab, merges, block=1)
        for _ in range(40):
            symbols = [r.randrange(2) for _ in range(r.randint(1, 120))]
            out, buffer = [], []
            for k in range(0, len(symbols), 5):
                done, buffer = t.stable(buffer + symbols[k:k + 5])
                out += done
            assert out + t.merge(list(buffer)) == t.merge(list(symbols))


def test_bpe_round_trip(docs, none):
    out = bpe_stream.encode_decode(docs, with_ids=True).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = encoded("byte_bpe_50k.json", t)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), t or "")] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in out) == want
    assert bpe_stream.encode_decode(none).count() == 0


def test_bpe_stream_of_blocks():
    e = bpe_stream.StreamEncoder(subwords.public_path("byte_bpe_50k.json"))
    r = random.Random(1)
    for text in ("".join(r.choice("abcdethion") for _ in range(70_000)), "!?" * 30_000, " " * 50_000 + "x", "9é" * 20_000, "x <|endoftext|> " * 300, "it's we'll\n\n  a\tb "):
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        for n in (1, 7, 50, 4099, 65536):
            short = text if n > 7 else text[:40_000]
            assert [i for part in e.stream(short[k:k + n] for k in range(0, len(short), n)) for i in part] == (want if short == text else e.tokenizer.encode(short, add_special_tokens=False).ids)
        d = bpe_stream.Decoder(e.bytes_of)
        assert "".join(d.push(want[k:k + 3]) for k in range(0, len(want), 3)) + d.finish() == text
    d = bpe_stream.Decoder({0: b"\xe6\x97", 1: b"\xa5", 2: b"a"})
    assert d.push([0]) == "" and d.push([1]) == "日" and d.push([0, 2]) == "�a" and d.push([0]) + d.finish() == "�"


def test_warc(spark):
    html = ["<p>x</p>", "WARC/1.1\r\n\r\nHTTP/1.1\r\n\r\n", "", None, "<p>x</p>", "tail\r\n", "\r\n\r\n", "<p>x</p>", "é" * 50_000]
    pages = [(9 - k, f"http://a.example.com/{k}?q=1", h, "x") for k, h in enumerate(html)] + [(None, None, "<p>x</p>", "y"), (2, "http://b.example.com", "<p>x</p>", "z"), (None, None, "only", "w")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    out = warc.round_trip(table).collect()
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = Counter()
    responses = set()
    for i, _, h, _ in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        h = h or ""
        response = (i == first.get(h)) and (i, h) not in responses
        responses.add((i, h))
        want[(i, len(h.encode()), sha(h), "response" if response else "revisit", None if response else first.get(h))] += 1
    assert Counter(tuple(r) for r in out) == want
    assert warc.round_trip(table.limit(0)).count() == 0
    only = warc.round_trip(table, min_bytes=1 << 20).collect()
    assert {r.record_type for r in only} == {"response"}


def test_warc_nested(spark, tmp_path):
    table = spark.createDataFrame([(1, "http://a.example.com/p?q", "<p>é</p>")], "page_id long, url string, html string")
    warc.write_archives(table, str(tmp_path / "w"))
    row = warc.captures(warc.read_records(spark, str(tmp_path / "w"), with_payload=True)).collect()[0]
    assert bytes(row.response.payload).decode() == "<p>é</p>" and row.request.http.startswith("GET /p?q HTTP/1.1") and row.metadata.fields == "page-id: 1\r\n"


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    x[1000:1400] = x[0] + 0.001 * r.standard_normal((400, 16))
    x[2000:2050] = x[3]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(3000, None, "s"), (3100, [0.0] * 16, "s"), (3200, [float("nan")] * 16, "s"), (3300, [1.0, None] + [0.0] * 14, "s"), (None, [1.0] * 16, "s")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = collision_ann.nearest(table, table.filter("vec_id % 100 = 0"), block_rows=1000).toPandas()
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, d[own.vec_id], rtol=1e-12, atol=0)
        hit, total = hit + len(set(own.vec_id) & set(order)), total + 10
    assert hit / total >= 0.95 and set(out.query_id) == set(range(0, 3000, 100))
    assert out[out.query_id == 2000].vec_id.tolist()[:3] == [3, 2001, 2002]  # ties to the smaller id
    twice = table.filter("vec_id < 300").union(table.filter("vec_id in (100, 7)"))  # a repeated query and a repeated candidate
    repeated = collision_ann.nearest(twice, twice.filter("vec_id % 100 = 0"), block_rows=64).toPandas()
    for q in (0, 100, 200):
        ids = np.array([*range(300), 7])
        ids = ids[ids != q]
        d = np.sqrt(((x[ids].astype(float) - x[q].astype(float)) ** 2).sum(1))
        own = repeated[repeated.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and len(set(own.vec_id) & set(ids[np.lexsort((ids, d))[:10]])) >= 9
        assert own.vec_id.value_counts().drop(7, errors="ignore").max() == 1
    few = table.filter("vec_id < 5")
    assert collision_ann.nearest(few, few.filter("vec_id = 0")).count() == 4
    assert collision_ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_toxicity(spark, none):
    r = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = prose(i + 1000, 40).split(" ")
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "vequra", "vequlo", "scum", "pathetic"]))
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    texts += [(None, None), (700, ""), (0, texts[0][1])]
    table = spark.createDataFrame(rows_of(texts), DOCS)
    marks = spark.createDataFrame(labels + [(3, None, 1)], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(table, marks).collect()
    truth = dict((i, t) for i, t, _ in labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in out) and len(out) == len(texts)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    left = toxicity.without_toxic(table, marks)
    assert left.schema == table.schema and {r.doc_id for r in left.collect()} == {r.doc_id for r in out if not r.predicted}
    assert toxicity.toxicity(none, marks).count() == 0
    assert toxicity.toxicity(table.limit(20), marks.limit(0)).count() == 20


def test_label_model_finds_rates_and_a_copied_voter():
    r = np.random.default_rng(0)
    y = r.random(40_000) < 0.2
    rates = np.array([[0.02, 0.05, 0.1, 0.03, 0.04], [0.6, 0.5, 0.7, 0.4, 0.5]])
    votes = r.random((len(y), 5)) < rates[y.astype(int)]
    votes = np.concatenate((votes, (votes[:, :1] ^ (r.random((len(y), 1)) < 0.01))), 1)
    got, pairs = toxicity.fit_label_model(len(y), votes.T.astype(float) @ votes, 0.2, 0.25)
    assert np.abs(got[:, :5] - rates).max() < 0.06 and {(p[0], p[1]) for p in pairs} == {(5, 0)}


def test_language_model(spark, none):
    texts = TEXTS + [(200 + i, prose(i, 120)) for i in range(150)]
    table = spark.createDataFrame(rows_of(texts), DOCS)
    shape = attention_lm.Shape(share=0.5, head_words=20)
    out = attention_lm.lm_scores(table, shape=shape).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts, ends = Counter(w for i, t in texts if not held(i) for w in WORD.findall(lower(t))), sum(not held(i) for i, _ in texts)
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, t in texts:
        c = [counts[w] for w in WORD.findall(lower(t))] + [ends]
        want.append((i, held(i), len(c), sum(x > 0 for x in c), total, round(sum(np.log10((x + 1) / (total + distinct + 1)) for x in c), 5)))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == Counter(want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    unseen = [r for r in out if r.held_out]
    assert sum(r.score for r in unseen) > 1.3 * sum(r.base_score for r in unseen)
    same = [r.score for r in out if r.doc_id in (0, 1)]
    assert abs(same[0] - same[1]) < 1e-3
    assert attention_lm.lm_scores(none).count() == 0


def test_language_model_learns_from_every_window(spark):
    import pyarrow as pa
    shape = attention_lm.Shape()
    texts = [np.full(3 + i % 40, 1000 + i, "<u4") for i in range(120)] + [np.zeros(0, "<u4"), np.arange(3000, 3200, dtype="<u4")]
    table = spark.createDataFrame([(i << 20, False, x.tobytes()) for i, x in enumerate(texts)] + [(1, True, np.full(9, 7, "<u4").tobytes())], "row long, held_out boolean, ids binary").repartition(3)
    model = attention_lm.fit(table, subwords.public_path("word_bpe_49k.json"), shape)
    first = attention_lm.Network(shape, np.zeros((len(model.class_of), 2))).p["e"]
    moved = np.abs(model.network.p["e"] - first).max(1) > 1e-4
    assert moved[model.symbol_of[np.unique(np.concatenate(texts))]].all()  # each id of each short text has reached the network
    symbols, ids = len(model.class_of), [model.symbol_of[x] for x in texts]
    _, *want = attention_lm.windows(ids, shape, symbols)
    assert model.trained == len(want[0])
    batches = lambda: [pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([x.tobytes() for x in texts], pa.binary())], ["row", "ids"])]
    got = [np.concatenate(x) for x in zip(*attention_lm.window_slices(batches(), shape, model.symbol_of, symbols, most=4))]
    assert all((a == b).all() for a, b in zip(got, want))
    turns = [x for r in range(shape.rounds) for x in attention_lm.in_batches(attention_lm.window_slices(batches(), shape, model.symbol_of, symbols, r, most=4), 16)]
    as_rows = lambda parts: Counter(map(bytes, np.concatenate([p[0] for p in parts])))
    assert as_rows(turns) == as_rows([want]) and sum(len(p[0]) < 16 for p in turns) <= shape.rounds
    marks = np.array([5, 0, symbols - 1])
    near = np.zeros((symbols + 1, 3))
    for row in want[0]:
        for x in row:
            near[x] += [(row == m).sum() for m in marks]
    assert (attention_lm.neighbours(table, shape, model.symbol_of, symbols, marks) == near).all()


def test_language_model_shares_are_formed_slice_by_slice():
    import tracemalloc
    shape, symbols, classes = attention_lm.Shape(), 500, 100
    r = np.random.default_rng(1)
    _, inputs, targets, scored = attention_lm.windows([r.integers(0, symbols - 1, n) for n in (0, 1, 23, 24, 25, 47, 9000)], shape, symbols)
    assert inputs.dtype == targets.dtype == np.uint16  # a quarter of the bytes of 64-bit numbers
    counts = r.random((symbols, classes)) ** 8 + 1e-9
    class_of = r.integers(0, classes, symbols)
    for scale in (1, 3000):  # logits near zero, and some that no exponential in 32 bits can hold
        net = attention_lm.Network(shape, np.log(counts / counts.sum(1, keepdims=True)))
        net.p["u"] = net.p["u"] * np.float32(scale)
        out, _ = net._hidden(inputs)
        logits = (out[:, :shape.size] @ net.p["u"] + net.p["b"] + net.prior[inputs[:, -shape.stride:].ravel()]).astype(float)
        assert (np.abs(logits).max() > 88) == (scale > 1)
        logs = logits - logits.max(1, keepdims=True)
        logs -= np.log(np.exp(logs).sum(1, keepdims=True))
        y = class_of[targets]
        tracemalloc.start()
        net._hidden(inputs)
        below = tracemalloc.get_traced_memory()[1]
        got = net.log_share(inputs, y.ravel())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(got, logs[np.arange(len(logs)), y.ravel()], rtol=1e-4, atol=1e-4)
        assert np.allclose(net.forward(inputs)[0], np.exp(logs), rtol=2e-3, atol=1e-5)
        assert peak < below + logits.size  # a quarter of the logits' bytes: those of all rows are never held
        d = np.exp(logs)
        d[np.arange(len(d)), y.ravel()] -= 1
        d *= scored.ravel()[:, None] / scored.sum()
        g = net.gradient(inputs, y, scored)
        assert np.allclose(g["b"], d.sum(0), atol=1e-5) and np.allclose(g["u"], out[:, :shape.size].T @ d, atol=1e-4)


def test_language_model_places_of_words():
    import pyarrow as pa
    words = lambda *x: pa.array(x, pa.string())
    assert attention_lm.places(words("a", "b", "", "c"), words("c", "x", "", "a")).tolist() == [3, 4, 2, 0]
    assert attention_lm.places(words(), words("a")).tolist() == [0] and attention_lm.places(words("a"), words()).tolist() == []


def test_language_model_gradients_and_windows():
    shape = attention_lm.Shape(width=8, stride=5, size=6, hidden=7)
    ids = [np.array([1, 2, 3, 4, 0, 1, 2]), np.array([], int)]
    owner, inputs, targets, scored = attention_lm.windows(ids, shape, 6)
    assert np.bincount(owner, scored.sum(1)).tolist() == [8, 1]  # each id and the end once
    assert targets[scored].tolist() == [1, 2, 3, 4, 0, 1, 2, 5, 5]
    r = np.random.default_rng(0)
    net = attention_lm.Network(shape, np.log(np.full((6, 4), 0.25)))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    classes = np.array([0, 1, 2, 3, 0, 1])[targets]

    def loss():
        p, _ = net.forward(inputs)
        return -(np.log(p[np.arange(len(p)), classes.ravel()]) * scored.ravel()).sum() / scored.sum()

    g = net.gradient(inputs, classes, scored)
    full = np.zeros_like(net.p["e"])
    full[g.pop("ids")] = g["e"]
    g["e"] = full
    for name, d in g.items():
        w = net.p[name]
        at = tuple(r.integers(0, n) for n in w.shape)
        old = w[at]
        w[at] = old + 1e-5
        high = loss()
        w[at] = old - 1e-5
        low = loss()
        w[at] = old
        assert abs((high - low) / 2e-5 - d[at]) < 1e-4, name


def test_pipeline(spark, tmp_path):
    toxic = [(300 + i, prose(400 + i, 80) + " idiot scum pathetic.") for i in range(40)]
    clean = [(500 + i, prose(700 + i, 80)) for i in range(160)]
    texts = TEXTS + family(20) + toxic + clean
    spark.createDataFrame(rows_of(texts), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 500)) for i, _ in toxic + clean], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [(i, t) for i, t in TEXTS + family(20) + clean if t and not counted(t)[-1]]
    want = {r[1] for r in near_by_force(good)}
    assert {r.doc_id for r in out} == want
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())


def test_encoding_needs_little_memory_beside_the_text():
    """The peak of a process that encodes 16 MB of text, above what the text and an encoder alone take."""
    code = """
import random, re, sys
import pyarrow as pa
from leafscan.llm import subwords
r = random.Random(1)
words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
batch = pa.RecordBatch.from_arrays([pa.array([" ".join(r.choices(words, k=800)) for _ in range(3500)])], ["text"])
path = subwords.public_path("word_bpe_49k.json")
subwords.encoder(path).encode(batch.column("text").slice(0, 200))
peak = lambda: int(re.search(r'VmHWM:\\s+(\\d+)', open('/proc/self/status').read())[1])
before = peak()
total = sum(len(ids) for _, _, ids in subwords.encoded(iter([batch]), path)) if sys.argv[1] == "all" else len(subwords.encoder(path).encode(batch.column("text").slice(0, 1800))[1])
print(total, peak() - before)
"""
    grown = {}
    for what in ("all", "eight"):
        done = subprocess.run([sys.executable, "-c", code, what], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
        total, grown[what] = map(int, done.stdout.split())
        assert total > 1_000_000
    assert grown["all"] < grown["eight"] / 2  # kilobytes; "eight": some 8 MB at once, as it was
