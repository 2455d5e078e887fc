"""File scans, path rules, odd files, sinks."""

import json

from builders import FIXTURES, source_files
from leafscan import audit
from leafscan.functions import text as tx
from leafscan.operators import callchain, js_rules, text_rules, tokens
from leafscan.plans import reports
from leafscan.sources import files as fs
from pyspark.sql import functions as F


def test_scan_of_a_folder(spark, tmp_path):
    for project, tree in FIXTURES.items():
        for path, text in tree.items():
            file = tmp_path / project / path
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(text)
    (tmp_path / "backend-risk" / "README.md").write_text("SELECT")
    rows = fs.scan_files(spark, str(tmp_path)).collect()
    assert {(r["project"], r["file_path"].split(f"{r['project']}/", 1)[1], r["content"]) for r in rows} == {
        (p, path, text) for p, tree in FIXTURES.items() for path, text in tree.items()}
    assert fs.sql_file_scan(spark, str(tmp_path)).count() == 1
    assert fs.source_file_scan(spark, str(tmp_path / "backend-risk"), "risk").select("project").distinct().first()[0] == "risk"
    scores = {r["project"]: r["score"] for r in audit(fs.scan_files(spark, str(tmp_path))).project_scores.collect()}
    assert scores == {"backend-risk": 39, "backend-layered": 80, "backend-safe": 100}


def test_ignored_paths(spark):
    paths = ["src/a.ts", "node_modules/x/a.ts", "a/dist/b.ts", ".git/a.ts", "a/b.test.ts", "a/b.spec.js", "tests/a.ts", "test/a.ts",
             "src/.next/a.ts", "build.ts", "gen/x/a.ts"]
    df = source_files(spark, {"p": {x: "" for x in paths}})
    kept = {r["file_path"] for r in fs.ignore_paths(df, ("gen/**",)).collect()}
    assert kept == {"/p/src/a.ts", "/p/test/a.ts", "/p/build.ts"}


def test_globs():
    import re
    for glob, yes, no in (("**/*.{ts,js}", "a/b.ts", "a/b.tsx"), ("a/?.ts", "a/b.ts", "a/bc.ts"), ("**/x/**", "x/y", "y/x")):
        pattern = tx.globs_pattern((glob,))
        assert re.match(pattern, yes) and not re.match(pattern, no)


def test_backend_root(spark):
    df = source_files(spark, {"m": {"apps/api/a.ts": "", "api/b.ts": "", "web/c.ts": ""}, "n": {"x.ts": ""}})
    kept = {(r["root"], r["file_path"]) for r in fs.select_backend_root(df).collect()}
    assert kept == {("/m/api", "/m/api/b.ts"), ("/n", "/n/x.ts")}


def test_bad_files_do_not_stop_the_audit(spark):
    df = source_files(spark, {"p": {"a.ts": "M.find().skip(1", "b.ts": "M.find().skip(1);", "c.ts": "f(])"}})
    a = audit(df)
    assert {(r["file_path"], r["reason"]) for r in a.bad_files.collect()} == {
        ("/p/a.ts", "unbalanced brackets"), ("/p/c.ts", "unbalanced brackets")}
    assert {r["file_path"] for r in a.raw_findings.collect()} == {"/p/b.ts"}


def test_long_texts(spark):
    """Long comments, strings, chains and one-line files: no recursion limit, no cap."""
    text = ("/*" + "x*\n" * 40_000 + "*/\n" + 'const s = "' + "\\\"y" * 40_000 + '";\n' + "// c\n" * 40_000
            + "M.find()" + ".a()" * 3_000 + ".skip(20000);" + "f(1);" * 30_000)
    facts = tokens.token_facts(source_files(spark, {"p": {"a.ts": text}}))
    hits = js_rules.chain_hits(facts)
    assert {r["rule_id"] for r in hits.collect()} == {"A01", "A02", "A03", "A04"}
    assert hits.filter("rule_id = 'A04'").first()["line_start"] == 80_003


def test_text_rules_on_unusual_files(spark):
    df = source_files(spark, {"p": {
        "dense.sql": "select dense_rank () over (order by a) from t",
        "both.sql": "SELECT a FROM t ORDER  BY a LIMIT 5 OFFSET 20000",
        "huge.sql": "select a from t offset " + "9" * 400,
        "wrap.ts": "a\nb\n  paginate (q)\nc\nd",
        "capped.ts": "const maxPageSize = 3;\npaginate(q).sort()",
        "words.ts": "// first after\nconst s = 'first';\nx.last();"}})
    got = {(r["file_path"][3:], r["rule_id"]) for r in text_rules.hit_rows(text_rules.text_facts(df)).collect()}
    assert got == {
        ("dense.sql", "Q03"), ("dense.sql", "Q07"), ("both.sql", "Q01"), ("both.sql", "Q05"), ("huge.sql", "Q01"),
        ("huge.sql", "Q03"), ("huge.sql", "Q04"), ("huge.sql", "Q05"), ("wrap.ts", "W01"), ("wrap.ts", "W02")}
    site = text_rules.wrapper_sites(df).filter("file_path LIKE '%wrap.ts'").first()
    assert (site["line"], site["code_snippet"]) == (3, "b\n  paginate (q)\nc")


def test_imports_and_chains(spark):
    tree = {"p": {
        "r.ts": 'import type { T } from "./t";\nimport ctl, {\n  save as store,\n} from "./ctl/index.js";\nimport x from "lib";\napp.get("/a", ctl);\napp.post("/b", store);\n',
        "ctl/index.ts": 'import { loop } from "../loop";\nexport default function main(a) { return loop(a); }\nexport const save = (a) => local(a);\nfunction local(a) { return save(a); }\n',
        "loop.ts": 'import main from "./ctl";\nexport function loop(a) {\n  other(a);\n  return main(a);\n}\nfunction other(a) { return a; }\n'}}
    a = audit(source_files(spark, tree))
    chains = {r["name"]: [(s["file_path"], s["symbol"]) for s in r["call_chain"]] for r in a.discovered.collect()}
    assert chains == {
        "GET /a": [("/p/ctl/index.ts", "main"), ("/p/loop.ts", "loop")],
        "POST /b": [("/p/ctl/index.ts", "save"), ("/p/ctl/index.ts", "local")]}
    assert callchain.call_steps(a.discovered).count() == 4


def test_joined_paths(spark):
    df = spark.createDataFrame([("/a/b", "../c"), ("a", "./x/../y"), ("/a", "../../z")], "d STRING, r STRING")
    got = [r[0] for r in df.select(tx.join_path(F.col("d"), F.col("r"))).collect()]
    assert got == ["/a/c", "a/y", "/z"]


def test_short_snippets(spark):
    df = spark.createDataFrame([("  a\r\n\n " + "b" * 60 + "\nc",)], "s STRING")
    assert df.select(tx.short_snippet(F.col("s"))).first()[0] == "a\n" + "b" * 49 + "…"


def test_snapshot_and_json(spark, tmp_path):
    a = audit(source_files(spark, FIXTURES))
    path = str(tmp_path / "snap")
    assert reports.read_recommendations(spark, path).count() == 0
    reports.write_snapshot(a, path, "r1")
    reports.write_snapshot(a, path, "r2")
    rows = reports.read_recommendations(spark, path).collect()
    assert {r["project"] for r in rows if r["state"] == "clean"} == {"backend-safe"}
    listed = sorted(r["rank"] for r in rows if r["project"] == "backend-layered")
    assert listed == list(range(1, len(listed) + 1)) and len(listed) > 5

    lines = [(r["project"], r["section"], json.loads(r["json"])) for r in reports.audit_json(a).collect()]
    report = next(j for p, s, j in lines if p == "backend-risk" and s == "report")
    assert (report["schemaVersion"], report["score"], report["detectedStrategy"], report["filesScanned"]) == (2, 39, "mixed", 3)
    assert report["breakdown"]["categories"]["Bounds"] == 72 and len(report["topUnits"]) == 4
    assert sum(1 for p, s, _ in lines if p == "backend-risk" and s == "finding") == 17
    safe = next(j for p, s, j in lines if p == "backend-safe" and s == "report")
    assert safe["issues"] == [] and safe["topUnits"] == []
    reports.write_json(a, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).filter("section = 'unit'").count() == 7


def test_own_rules_and_plain_audit(spark):
    rules = spark.createDataFrame([("MISSING_LIMIT", "Bounds", 50)], "code STRING, category STRING, points INT")
    a = audit(source_files(spark, FIXTURES), rules=rules, call_chains=False)
    scores = {r["name"]: r["score"] for r in a.unit_scores.filter("project = 'backend-risk'").collect()}
    assert scores["src/services/users.sql"] == 50
    assert a.discovered.filter("call_chain IS NOT NULL").count() == 0


def test_scan_keeps_every_name(spark, tmp_path):
    root = tmp_path / "check outs"
    tree = {"a/_app.tsx": "1", "a/_shared/x.ts": "2", "a/[id].ts": "3", "b/my dir/y z.ts": "4", "b/a%20b.ts": "5", "_c/q.sql": "6", "a/no.md": "7", "a/.hid/z.ts": "8", "a/empty.ts": ""}
    for name, content in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    found = {(r.project, r.root, r.file_path, r.content) for r in fs.scan_files(spark, str(root)).collect()}
    assert found == {(n.split("/")[0], f"{root}/{n.split('/')[0]}", f"{root}/{n}", c) for n, c in tree.items() if not n.endswith(".md")}
    rounds = {(r.project, r.root, r.file_path, r.content) for r in fs.scan_files(spark, str(root), list_entries=1).collect()}
    assert rounds == found  # a folder a round
    (root / "loose.ts").write_text("9")
    loose = [(r.project, r.root, r.file_path) for r in fs.source_file_scan(spark, str(root)).collect() if r.content == "9"]
    assert loose == [("check outs", str(root), f"{root}/loose.ts")]
    one = {(r.project, r.root, r.file_path) for r in fs.sql_file_scan(spark, f"file://{str(root).replace(' ', '%20')}", "p").collect()}
    assert one == {("p", str(root), f"{root}/_c/q.sql")}


def test_orm_hints_of_the_whole_project(spark):
    a = audit(source_files(spark, {"p": {"backend/a.ts": "", "packages/prisma/client.ts": ""}}))
    assert [r["orm"] for r in a.project_context.collect()] == [["Prisma"]]


def test_settled_tables(spark, tmp_path):
    import os
    from types import SimpleNamespace

    import pytest

    from leafscan.session import shared_folder

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getConf=lambda: {}, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(unset)
    with audit(source_files(spark, {"p": {"a.ts": "M.find().skip(1);"}})) as a:
        assert a.findings.count() > 0
        folders = list(a.settled)
        assert folders and all(os.path.isdir(f) for f in folders)
    assert not any(os.path.exists(f) for f in folders)


def test_stored_files_are_lexed_where_they_lie(spark, tmp_path):
    df = source_files(spark, FIXTURES)
    df = df.union(df.select(F.concat(F.lit("more-"), "project"), *df.columns[1:])).withColumn("leafscan_H3", F.lit(1)).withColumn("size", F.lit("x"))
    stored = fs.store(df, "stored_sources", str(tmp_path / "stored"), 3)
    assert stored.columns == ["project", "root", "file_path", "content", *fs.FILE_KEYS] and stored.count() == df.count()
    assert len({p.name.split("_")[-1] for p in (tmp_path / "stored").glob("part-*.parquet")}) <= 3
    try:
        roots = F.broadcast(spark.createDataFrame([("no-project", "src")], "project string, backend_dir string"))
        facts, plain = (tokens.token_facts(fs.audited_files(x, roots=roots).filter(fs.is_code(F.col("file_path")))) for x in (stored, df))
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (facts, plain)]
        # One exchange of the tokens as arrays, for plain files one of the text; each file is lexed once.
        assert [p.count("Exchange hashpartitioning(h1") for p in plans] == [1, 2] and [p.count("ArrowEvalPython") for p in plans] == [1, 1]
        assert "ENSURE_REQUIREMENTS" not in plans[0] + plans[1] and plans[0].count("Bucketed: true") >= 1
        assert facts.exceptAll(plain).isEmpty() and plain.exceptAll(facts).isEmpty() and not facts.isEmpty()
        again = fs.store(stored, "stored_again", str(tmp_path / "again"), 2)
        assert again.columns == stored.columns and again.exceptAll(stored).isEmpty()
        empty = fs.store(df.limit(0), "stored_nothing", str(tmp_path / "nothing"))
        assert tokens.token_facts(fs.audited_files(empty)).isEmpty()
        scores = {r["project"]: r["score"] for r in audit(stored).project_scores.collect()}
        assert scores == {p + q: n for p in ("", "more-") for q, n in (("backend-risk", 39), ("backend-layered", 80), ("backend-safe", 100))}
    finally:
        for name in ("stored_sources", "stored_again", "stored_nothing"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_backend_folders_work_out_each_path_once(spark):
    rows = [("a", "/a", "/a/api/x.ts"), ("a", "/a", "/a/backend/y.ts"), ("a", "/a", "/b/backend/z.ts"), ("b", "/b", "/b/src/x.ts"), (None, "/c", "/c/server/x.ts"), ("d", None, "api/x.ts"), ("e", "/e", None)]
    found = fs.backend_roots(spark.createDataFrame(rows, "project string, root string, file_path string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", "backend"), (None, "server"), ("d", "api")], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ltrim(") == 1
