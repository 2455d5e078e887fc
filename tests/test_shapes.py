"""Tokens are worked on as columns: no rows of single tokens in the plan, groups keep apart, slices change nothing."""

import numpy as np
from pyspark.sql import functions as F

from builders import source_files
from leafscan.operators import shapes, tokens

CODE = {
    "a.ts": "export function f(M, q) {\n  return M.find({ a: 1 }).skip((q - 1) * 20, x => x).limit(5);\n}\n",
    "b.ts": "const o = { Query: { list: all, 'own': own } };\nlet limit = Math.min(req.query.limit, 50);\nconst u = () => run(a);\n",
    "c.ts": "class C {\n  @Get('x')\n  one(q) {}\n}\n",
    "d.ts": None,
}


def test_no_rows_of_tokens(spark):
    df = source_files(spark, {"p": CODE})
    plan = tokens.token_facts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("ArrowEvalPython") == 1


def test_facts(spark):
    rows = {}
    for r in tokens.token_facts(source_files(spark, {"p": CODE})).collect():
        rows.setdefault((r.file_path[3:], r.fact), []).append(r)
    skip, limit = sorted(rows["a.ts", "call"], key=lambda r: r.n)
    assert (skip.names, skip.text, skip.arg0_kind, skip.arg0_text, skip.arg1_kind, skip.arg1_text, skip.mult, skip.line_start) == (
        ["find", "skip"], "M.find({ a: 1 }).skip((q - 1) * 20, x => x)", "expression", "(q - 1) * 20", "function", "x => x", True, 2)
    assert (limit.names, limit.arg0_kind, limit.arg1_kind, limit.mult) == (["find", "skip", "limit"], "number", None, False)
    assert [(r.name, r.owner, r.symbol, r.text) for r in sorted(rows["b.ts", "prop"], key=lambda r: r.n)] == [
        ("list", "Query", "all", "list: all"), ("own", "Query", "own", "'own': own")]
    assert [(r.name, r.text) for r in rows["b.ts", "declarator"]] == [("limit", "limit = Math.min(req.query.limit, 50)")]
    assert len(rows["b.ts", "cap"]) == 1 and rows["b.ts", "icall"][0].name == "run"
    assert [(r.name, r.symbol, r.line_start) for r in rows["c.ts", "decorator"]] == [("Get", "x", 2)] and rows["c.ts", "method"][0].name == "one"
    assert not any(path == "d.ts" for path, _ in rows)


def test_slices_change_nothing(spark, monkeypatch):
    df = source_files(spark, {p: CODE for p in "pqr"})
    whole = sorted(map(str, tokens.token_facts(df).collect()))
    monkeypatch.setattr(shapes, "SLICE_TOKENS", 1)
    assert sorted(map(str, tokens.token_facts(df).collect())) == whole != []


def test_rows_of_one_path_are_one_file(spark):
    df = source_files(spark, {"p": {"a.ts": "M.find();\n"}})
    shown = tokens.tokens(df.union(df)).orderBy("n").select(F.collect_list("t")).first()[0]
    assert shown == ["M", "M", ".", ".", "find", "find", "(", "(", ")", ")", ";", ";"]


def test_runs():
    runs = shapes.Runs(np.array([True, False, False, True, False]))
    test, values = np.array([False, True, False, False, True]), np.array([1, 2, 3, 4, 5])
    assert runs.last(test).tolist() == [-1, 1, 1, -1, 4] and runs.before(test).tolist() == [-1, -1, 1, -1, -1]
    assert runs.sum(values).tolist() == [1, 3, 6, 4, 9] and runs.sum_before(values).tolist() == [0, 1, 3, 0, 4]
    assert runs.lag(values, 1, 0).tolist() == [0, 1, 2, 0, 4] and runs.lead(values, 2, 0).tolist() == [3, 0, 0, 0, 0]
    none = shapes.Runs(np.zeros(0, bool))
    assert none.last(np.zeros(0, bool)).tolist() == none.lag(np.zeros(0, int), 2, 0).tolist() == []
