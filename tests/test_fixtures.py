"""The three fixture projects end to end, against hand-derived results."""

import pytest

from builders import FIXTURES, source_files
from leafscan import audit
from leafscan.plans import reports


@pytest.fixture(scope="module")
def a(spark):
    return audit(source_files(spark, FIXTURES))


def by_project(df, *columns):
    return {r["project"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_files_and_findings(a):
    assert by_project(a.project_context, "files_scanned") == {"backend-risk": (3,), "backend-layered": (4,), "backend-safe": (1,)}
    counts = {r["project"]: r["count"] for r in a.raw_findings.groupBy("project").count().collect()}
    assert counts == {"backend-risk": 15, "backend-layered": 4}
    counts = {r["project"]: r["count"] for r in a.findings.groupBy("project").count().collect()}
    assert counts == {"backend-risk": 17, "backend-layered": 6}
    assert a.bad_files.count() == 0


def test_units(a):
    rows = {(r["project"], r["name"]): (r["score"], r["status"], float(r["weight"])) for r in a.unit_scores.collect()}
    assert rows == {
        ("backend-risk", "src/services/users.sql"): (15, "Critical", 1.5),
        ("backend-risk", "src/controllers/userController.ts"): (20, "Critical", 1.5),
        ("backend-risk", "<project>"): (52, "High Risk", 1.5),
        ("backend-risk", "Query.feed"): (73, "Needs Optimization", 1.25),
        ("backend-layered", "src/repositories/usersRepo.ts"): (75, "Good", 1.25),
        ("backend-layered", "<project>"): (80, "Good", 1.25),
        ("backend-layered", "GET /users"): (85, "Good", 1.25),
    }


def test_project_scores(a):
    assert by_project(a.project_scores, "score", "status") == {
        "backend-risk": (39, "Critical"), "backend-layered": (80, "Good"), "backend-safe": (100, "Production Grade")}
    rows = {(r["project"], r["category"]): r["score"] for r in a.project_categories.collect()}
    risk = {"Bounds": 72, "Ordering": 87, "DepthCost": 69, "CursorStability": 88, "Consistency": 80}
    layered = {"Bounds": 85, "Ordering": 89, "DepthCost": 90, "Consistency": 88}
    assert rows == {**{("backend-risk", k): v for k, v in risk.items()}, **{("backend-layered", k): v for k, v in layered.items()}}


def test_metrics(a):
    rows = {r["project"]: r.asDict() for r in a.project_metrics.collect()}
    risk, layered, safe = rows["backend-risk"], rows["backend-layered"], rows["backend-safe"]
    names = ("units_scored", "units_with_issues", "critical_units", "high_units", "units_with_bounds", "bounds_coverage_percent",
             "offset_units", "offset_usage_percent", "cursor_units", "keyset_usage_percent", "stable_order_coverage_percent",
             "deep_offset_units", "unbounded_units", "unsafe_sort_units")
    assert [risk[n] for n in names] == [4, 4, 3, 4, 1, 25, 2, 50, 1, 25, 50, 1, 3, 0]
    assert [layered[n] for n in names] == [3, 3, 0, 3, 2, 67, 1, 33, 0, 0, 67, 0, 1, 0]
    assert [safe[n] for n in names] == [0, 0, 0, 0, 0, None, 0, None, 0, None, None, 0, 0, 0]


def test_strategy_actions_gate(a):
    assert by_project(a.strategies, "detected_strategy") == {
        "backend-risk": ("mixed",), "backend-layered": ("offset",), "backend-safe": ("none",)}
    actions = {r["project"]: r["count"] for r in a.next_actions.groupBy("project").count().collect()}
    assert actions == {"backend-risk": 3, "backend-layered": 2}
    assert by_project(a.gate_verdicts, "failed") == {
        "backend-risk": (True,), "backend-layered": (False,), "backend-safe": (False,)}


def test_top_units_and_chain(a):
    top = [r["name"] for r in a.top_units.filter("project = 'backend-risk'").orderBy("rank").collect()]
    assert top == ["src/services/users.sql", "src/controllers/userController.ts", "<project>", "Query.feed"]
    chain = a.discovered.filter("name = 'GET /users'").first()["call_chain"]
    assert [(s["file_path"], s["symbol"], s["line"]) for s in chain] == [
        ("/backend-layered/src/controllers/usersController.ts", "getUsers", 3)]


def test_issue_lists(a):
    counts = {r["project"]: r["count"] for r in a.issues.groupBy("project").count().collect()}
    assert counts == {"backend-risk": 17, "backend-layered": 6}
    recs = [r["recommendation"] for r in a.recommendations.filter("project = 'backend-layered'").orderBy("rank").collect()]
    assert recs[-3:] == [
        "Switch to keyset pagination where endpoints are high-volume.",
        "Add composite index for stable cursor sort keys (e.g. createdAt, _id).",
        "Enforce max page size = 50 at validation layer."]


def test_summary(a):
    row = reports.audit_summary(a).filter("project = 'backend-risk'").first()
    assert row["headline"] == "Score: 39/100 (Critical)"
    assert row["scope"] == "Strategy: mixed | Files: 3"
    assert row["hotspots"] == "1 deep-offset units | 3 unbounded units"
    assert row["top"].split("\n")[0] == "src/services/users.sql [critical] issues=5 @ /backend-risk/src/services/users.sql:1"
    assert len(row["first_issues"].split("\n")) == 4 and len(row["quick_wins"].split("\n")) == 3
