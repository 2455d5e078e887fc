"""Grouping, scoring, enrichment and advice on hand-built findings."""

import random

import pytest
from pyspark.sql import functions as F

from builders import findings, source_files, units
from leafscan import rulebook as rb
from leafscan.operators import enrich, findings as fd, grouping, metrics, scoring, text_rules


def score(spark, rows):
    grouped = findings(spark, [{**r, "unit_id": "u"} for r in rows]).withColumn("unit_key", F.lit("u"))
    unit = units(spark, [{"key": "u", "file": "/p/a.ts"}])
    return scoring.score_units(unit, grouped).first()


@pytest.mark.parametrize("code,category,points", rb.RULES)
def test_points_per_code(spark, code, category, points):
    assert score(spark, [{"code": code}])["score"] == 100 - points


def test_score_rules(spark):
    assert score(spark, [])["score"] == 100
    assert score(spark, [])["status"] == "Production Grade"
    assert score(spark, [{"code": "MISSING_LIMIT", "message": str(i)} for i in range(3)])["score"] == 70
    assert score(spark, [{"code": c} for c in ("MISSING_LIMIT", "DEEP_OFFSET", "NO_ORDER_BY")])["score"] == 35
    capped = score(spark, [{"code": c} for c in (
        "MISSING_LIMIT", "DEEP_OFFSET", "NO_ORDER_BY", "OFFSET_USED", "NO_PAGE_SIZE_CAP", "MULTIPLE_UNBOUNDED_ENDPOINTS")])
    assert (capped["score"], capped["status"]) == (15, "Critical")
    assert score(spark, [{"code": "DEEP_OFFSET", "confidence": 0.5}])["score"] == 90
    assert score(spark, [{"code": "DEEP_OFFSET", "confidence": -3.0}])["score"] == 100
    assert score(spark, [{"code": "DEEP_OFFSET", "confidence": 7.0}])["score"] == 80


def test_deductions_keep_first_of_equal_points(spark):
    rows = findings(spark, [
        {"code": "OFFSET_USED", "message": "low", "confidence": 0.2},
        {"code": "MISSING_LIMIT", "message": "first"},
        {"code": "MISSING_LIMIT", "message": "second"},
        {"code": "OFFSET_USED", "message": "high"}]).withColumn("unit_key", F.lit("u"))
    got = scoring.unit_deductions(scoring.code_points(rows)).first()["deductions"]
    assert [(d["code"], d["points"], d["reason"]) for d in got] == [("OFFSET_USED", 10, "high"), ("MISSING_LIMIT", 30, "first")]


def test_zero_confidence_keeps_its_category(spark):
    rows = findings(spark, [{"code": "OFFSET_USED", "confidence": 0.0}]).withColumn("unit_key", F.lit("u"))
    got = scoring.unit_categories(scoring.code_points(rows)).first()
    assert (got["category"], got["category_score"]) == ("DepthCost", 100)


def test_project_score_weights(spark):
    rows = spark.createDataFrame(
        [("p", "a", 30, 1.5), ("p", "b", 100, 1.0)], "project STRING, unit_key STRING, score INT, weight DOUBLE")
    projects = spark.createDataFrame([("p",), ("empty",)], "project STRING")
    got = {r["project"]: (r["score"], r["status"]) for r in scoring.project_scores(projects, rows).collect()}
    assert got == {"p": (58, "High Risk"), "empty": (100, "Production Grade")}
    cats = spark.createDataFrame(
        [("p", "a", "Bounds", 60), ("p", "b", "Bounds", 100)], "project STRING, unit_key STRING, category STRING, category_score INT")
    even = rows.withColumn("weight", F.lit(1.0))
    assert scoring.project_categories(even, cats).first()["score"] == 80


def test_enrichment(spark):
    def added(rows):
        return {r["code"] for r in enrich.project_findings(findings(spark, rows)).collect()}

    assert "INCONSISTENT_PAGE_SIZE_CONTROL" in added([
        {"code": "OFFSET_USED", "file": "a.ts"}, {"code": "NO_PAGE_SIZE_CAP", "file": "a.ts"}, {"code": "OFFSET_USED", "file": "b.ts"}])
    assert "MULTIPLE_UNBOUNDED_ENDPOINTS" in added([{"code": "MISSING_LIMIT"}, {"code": "MISSING_LIMIT"}])
    assert "MULTIPLE_UNBOUNDED_ENDPOINTS" not in added([{"code": "MISSING_LIMIT"}])
    assert added([{"code": "UNSTABLE_CURSOR"}]) == {"CONCURRENT_WRITES_RISK"}
    assert added([{"code": "DYNAMIC_SORT_UNSAFE"}]) == {"ORDER_BY_WITHOUT_INDEX_HINT"}
    assert added([{"code": "OFFSET_USED"}, {"code": "NO_ORDER_BY"}]) == {"CONCURRENT_WRITES_RISK", "ORDER_BY_WITHOUT_INDEX_HINT"}


def test_dedupe_ignores_lines_and_keeps_the_first(spark):
    rows = findings(spark, [
        {"code": "OFFSET_USED", "line": 9}, {"code": "OFFSET_USED", "line": 3}, {"code": "OFFSET_USED", "file": "/p/b.ts"}])
    got = sorted((r["file_path"], r["line_start"]) for r in fd.dedupe_findings(rows).collect())
    assert got == [("/p/a.ts", 9), ("/p/b.ts", None)]


def test_assignment(spark):
    us = units(spark, [
        {"key": "u1", "file": "/p/a.ts", "start": 5, "end": 20}, {"key": "u2", "file": "/p/a.ts", "start": 8, "end": 12},
        {"key": "u3", "file": "/p/r.ts", "start": 1, "end": 2, "chain": ["/p/Repo.ts"]},
        {"key": "u4", "file": "/p/s.ts", "start": 1, "end": 2, "chain": ["/p/repo.ts"]}])
    fs = findings(spark, [
        {"code": "OFFSET_USED", "line": 10}, {"code": "NO_ORDER_BY", "line": 99}, {"code": "DEEP_OFFSET", "file": "/p/other.ts", "unit_id": "u2"},
        {"code": "OFFSET_USED", "file": "/p/repo.ts"}, {"code": "OFFSET_USED", "file": "/p/lone.ts", "unit_id": "gone"}])
    got = {(r["code"], r["file_path"]): r["unit_key"] for r in grouping.group_findings(fs, us).collect()}
    assert got == {
        ("OFFSET_USED", "/p/a.ts"): "u1", ("NO_ORDER_BY", "/p/a.ts"): "u1", ("DEEP_OFFSET", "/p/other.ts"): "u2",
        ("OFFSET_USED", "/p/repo.ts"): "u3", ("OFFSET_USED", "/p/lone.ts"): "file:/p/lone.ts"}


def test_assignment_against_brute_force(spark):
    """One file holds a third of all findings and units."""
    rng = random.Random(7)
    files = [f"/p/f{i}.ts" for i in range(12)]
    pick = lambda: files[0] if rng.random() < 0.34 else rng.choice(files)
    us = []
    for i in range(120):
        start = rng.randint(1, 60)
        us.append({"key": f"u{i}", "file": pick(), "start": start, "end": start + rng.randint(0, 25),
                   "chain": [rng.choice(files + ["/p/x.ts", "/p/Y.ts"]) for _ in range(rng.randint(0, 2))]})
    fs = [{"code": "OFFSET_USED", "message": f"m{i}", "file": rng.choice([pick(), "/p/x.ts", "/p/y.ts", "/p/z.ts"]), "line": rng.randint(1, 90)}
          for i in range(400)]

    def expected(f):
        same = [u for u in us if u["file"] == f["file"]]
        if same:
            return next((u["key"] for u in same if u["start"] <= f["line"] <= u["end"]), same[0]["key"])
        through = [u for u in us if any(c.lower() == f["file"].lower() for c in u["chain"])]
        return through[0]["key"] if through else f"file:{f['file']}"

    got = {r["message"]: r["unit_key"] for r in grouping.group_findings(findings(spark, fs), units(spark, us)).collect()}
    assert got == {f["message"]: expected(f) for f in fs}


def test_one_file_of_many_units(spark):
    rng = random.Random(3)
    us = []
    for i in range(20_000):
        start = rng.randint(1, 60_000)
        us.append({"key": f"u{i:05}", "file": "/p/a.ts", "start": start, "end": start + rng.choice([0, 1, 7, 500, 20_000])})
    fs = [{"code": "OFFSET_USED", "message": f"m{i}", "file": "/p/a.ts", "line": rng.choice([0, 1, rng.randint(1, 90_000)])} for i in range(300)]
    grouped = grouping.group_findings(findings(spark, fs), units(spark, us))
    got = {r["message"]: r["unit_key"] for r in grouped.collect()}
    assert got == {f["message"]: next((u["key"] for u in us if u["start"] <= f["line"] <= u["end"]), us[0]["key"]) for f in fs}
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan  # units travel as rows


@pytest.mark.parametrize("path,layer", [
    ("/a/routes/x.ts", "route"), ("/a/controllers/x.ts", "controller"), ("/a/services/x.ts", "service"), ("/a/x.sql", "sql"),
    ("/a/resolvers/x.ts", "graphql"), ("/a/misc/x.ts", "unknown"), ("/a/Repo/x.ts", "repository"), ("C:\\a\\utils\\x.ts", "utility")])
def test_layers(spark, path, layer):
    assert grouping.classify(findings(spark, [{"code": "OFFSET_USED", "file": path}])).first()["layer"] == layer


def test_report_keeps_the_most_severe(spark):
    rows = findings(spark, [
        {"code": "OFFSET_USED", "severity": "medium", "message": "a"}, {"code": "OFFSET_USED", "severity": "high", "message": "b"},
        {"code": "MISSING_LIMIT", "severity": "critical", "file": "<project>", "message": "c"}])
    got = metrics.order_report(metrics.report_findings(rows)).collect()
    assert [r["message"] for r in got] == ["b", "c"]


def test_gates(spark):
    fs = findings(spark, [{"code": "MISSING_LIMIT", "severity": "critical"}, {"code": "OFFSET_USED", "severity": "high"}])
    assert metrics.gate_severity(fs).count() == 1
    strict = spark.createDataFrame([("p", "low", "cursor")], "project STRING, max_allowed_severity STRING, enforce_strategy STRING")
    assert metrics.gate_severity(fs, strict).count() == 2
    used = spark.createDataFrame([("p", "offset")], "project STRING, detected_strategy STRING")
    assert metrics.gate_strategy(used, strict).count() == 1
    assert metrics.gate_strategy(used).count() == 0


def test_advice(spark):
    rows = findings(spark, [
        {"code": "OFFSET_USED", "advice": "same", "cause": "c1"}, {"code": "OFFSET_USED", "advice": "same", "file": "/p/b.ts", "cause": "c1"},
        {"code": "NO_ORDER_BY", "advice": "other"}])
    recs = [r["recommendation"] for r in metrics.recommendations(rows).orderBy("rank").collect()]
    assert recs == ["same", "other", "Switch to keyset pagination where endpoints are high-volume.",
                    "Add composite index for stable cursor sort keys (e.g. createdAt, _id)."]
    assert [r["root_cause"] for r in metrics.root_causes(rows).collect()] == ["c1"]
    assert metrics.recommendations(findings(spark, [])).count() == 0


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_findings_meet_units_in_one_join(spark):
    rows = [{"code": "OFFSET_USED", "line": 5}, {"code": "OFFSET_USED", "line": 5}, {"code": "MISSING_LIMIT", "line": 90}, {"code": "NO_ORDER_BY", "unit_id": "b"},
            {"code": "NO_ORDER_BY", "file": "/p/C.ts"}, {"code": "NO_ORDER_BY", "file": "/p/d.ts"}, {"code": "DEEP_OFFSET", "file": None, "unit_id": "b"},
            {"code": "DEEP_OFFSET", "file": None}, {"code": "DEEP_OFFSET", "project": None, "line": 5}, {"code": "DEEP_OFFSET", "project": None, "unit_id": "b"}]
    found = [{"key": "a", "file": "/p/a.ts", "start": 1, "end": 9, "chain": ["/P/c.ts"]}, {"key": "b", "file": "/p/a.ts", "start": 4, "end": 6}]
    got = grouping.assign_units(findings(spark, rows), units(spark, found))
    assert [tuple(r) for r in got.orderBy("finding_ord").select("unit_key", "assigned_by").collect()] == [
        ("a", "file"), ("a", "file"), ("a", "file"), ("b", "preset"), ("a", "chain"), ("file:/p/d.ts", "fallback"), ("b", "preset"), (None, "fallback"),
        ("file:/p/a.ts", "fallback"), ("file:/p/a.ts", "fallback")]
    wide = [n for n in nodes(got._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join" and "message" in n.output().toString()]
    assert len(wide) == 1  # was one for each way to find a unit, and each exchanges and sorts the findings with all their texts


def test_text_pass_works_out_each_flag_once(spark):
    files = source_files(spark, {"p": {"a.sql": "SELECT * FROM t OFFSET 5", "b.ts": "const a = 1;", "c.ts": "f(args.first, args.after);", "d.ts": "// first"}})
    got = text_rules.text_facts(files)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_joined(") == 1 and plan.count("paginate") and plan.count("(?:orderBy|sort|ORDER BY)") == 1
    assert sorted((r["file_path"], r["rule_id"]) for r in got.collect()) == [
        ("/p/a.sql", "Q01"), ("/p/a.sql", "Q03"), ("/p/a.sql", "Q04"), ("/p/a.sql", "Q06"), ("/p/c.ts", "G01"), ("/p/c.ts", "G02")]
