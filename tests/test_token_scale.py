"""The token job at size: partitions grow with the text, settled stages stay small enough to be compiled."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from leafscan import session
from leafscan.operators import lexer, tokens
from leafscan.sources import corpus


def _files(spark, n):
    text = F.concat(F.lit("export const f = (M) =>\n  M.find({}).skip("), F.col("id").cast("string"), F.lit(").limit(20);\n"))
    return spark.range(n).select(F.lit("p").alias("project"), F.concat(F.lit("/p/f"), "id", F.lit(".ts")).alias("file_path"), text.alias("content"))


def test_partitions_grow_with_the_text(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tokens.parts_of(_files(spark, 10)) == least
    assert tokens.parts_of(_files(spark, 10).filter("false")) == least
    few = sorted(map(str, tokens.token_facts(_files(spark, 60)).collect()))
    monkeypatch.setattr(tokens, "TASK_BYTES", 200)
    size = _files(spark, 60).agg(F.sum(F.octet_length("content"))).first()[0]
    assert tokens.parts_of(_files(spark, 60)) == -(-size // 200) > least
    assert tokens.keyed(_files(spark, 60)).rdd.getNumPartitions() == -(-size // 200)
    assert sorted(map(str, tokens.token_facts(_files(spark, 60)).collect())) == few != []


def test_settled_stages_can_be_compiled(spark, monkeypatch):
    class Writer:
        def mode(self, _):
            return self

        def parquet(self, path):
            seen.append(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))
            spark.range(3).write.parquet(path)

    class Frame:
        sparkSession, schema, write = spark, spark.range(0).schema, Writer()

    seen, before = [], spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    assert session.settle(Frame(), "rows").count() == 3
    assert seen == ["8000"] and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_views_exchange_texts_and_not_tokens(spark):
    rows = [("p", "/p/a.ts", "a.b(1);\nc"), ("p", "/p/a.ts", "x.y(2)"), ("p", "/p/a.ts", None), ("p", "/p/null.ts", None), ("p", "/p/empty.ts", ""), ("q", "/p/a.ts", "f(`${g.h(3)}`)")]
    files = spark.createDataFrame(rows, "project string, file_path string, content string").repartition(3)
    for view in (tokens.tokens, tokens.brackets, tokens.member_calls):
        plan = view(files)._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan  # tokens come from no step below the exchange
    want = Counter((project, path, "}" if t == lexer.TEMPLATE_CLOSE else t) for project, path, text in rows for t in lexer.lex(text or "", every=True)[0] if t)
    assert Counter((r.project, r.file_path, r.t) for r in tokens.tokens(files).collect()) == want
    assert sorted((r.file_path, r.open_n, r.name) for r in tokens.member_calls(files).filter("project = 'q'").collect()) == [("/p/a.ts", 7, "h")]


def test_texts_are_lexed_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(lexer, "SLICE_BYTES", 50)
    parts = []

    def of_batches(batches):
        for batch in batches:
            parts.append((batch.num_rows, batch.column("copies").to_pylist()))
            yield batch

    texts = ["ab.c(1)" * n for n in (1, 9, 0, 3, 3)]
    lists = pa.array([[{"content": texts[0]}, {"content": None}], [{"content": texts[1]}], [], [{"content": texts[2]}, {"content": texts[3]}], [{"content": texts[4]}]])
    whole = pa.RecordBatch.from_arrays([pa.array(list("abcde")), pa.array(list("vwxyz")), lists], ["project", "file_path", "texts"])
    out = pa.Table.from_batches(lexer.over_texts(of_batches, "every")([whole, whole.slice(2)]))
    assert out.column("project").to_pylist() == list("abcdecde") and len(parts) > 3
    want = [[lexer.lex(x["content"] or "", every=True)[0] for x in row.as_py()] for row in lists]
    assert [[x["tokens"]["t"] for x in row] for row in out.column("copies").to_pylist()] == want + want[2:]


def test_shuffles_of_settled_tables_are_removed(spark):
    setting, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(setting, None)

    class Writer:
        def __init__(self, writer):
            self.writer = writer

        def mode(self, x):
            return Writer(self.writer.mode(x))

        def option(self, *x):
            return Writer(self.writer.option(*x))

        def parquet(self, path):
            seen.append(spark.conf.get(setting))
            self.writer.parquet(path)

    rows = spark.range(1000).repartition(3, "id")

    class Frame:
        sparkSession, schema, write = spark, rows.schema, Writer(rows.write)

    kept = session.settle(Frame(), "rows", codec="zstd")
    assert kept.count() == 1000 and seen == ["true"] and spark.conf.get(setting, None) == before
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles())


def test_tables_of_prose_are_exchanged_once(spark, tmp_path):
    tables = {"documents": ([(1, "a", "en"), (1, "a", "en"), (2, None, None)], "doc_id long, text string, lang string"),
              "pages": ([(1, "<p>"), (None, "x")], "page_id long, html string"), "conversations": ([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None)], "conv_id long, turn int, role string, text string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus.prose_corpus(spark, str(tmp_path))
    text = corpus.PROSE_SQL
    for name in tables:
        text = text.replace("{%s}" % name, f"parquet.`{tmp_path}/{name}.parquet`")
    assert sorted(map(str, found.collect())) == sorted(map(str, spark.sql(text).collect()))
    assert found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("ReusedExchange") == 3
