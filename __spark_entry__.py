
from __future__ import annotations

import importlib
import os
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import oracles as o  # noqa: E402
from leafscan import Audit, rulebook as rb  # noqa: E402
from leafscan.functions import text as tx  # noqa: E402
from leafscan.operators import callchain, discovery, enrich, findings as fd, grouping, js_rules, metrics, scoring  # noqa: E402
from leafscan.operators import text_rules, tokens  # noqa: E402
from leafscan.plans import reports  # noqa: E402
from leafscan.session import settle, shared_folder  # noqa: E402
from leafscan.sources import corpus, files as fs  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
_FILES: dict = {}
_AUDITS: dict = {}


def _files(spark: SparkSession, sf_dir: str, build=corpus.code_corpus) -> DataFrame:
    """The source file table derived from the given tables, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
    if key not in _FILES:
        _FILES[key] = settle(build(spark, sf_dir), build.__name__, codec="zstd")
    return _FILES[key]


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, corpus.tree_corpus)


def _audit(spark: SparkSession, sf_dir: str, build=corpus.code_corpus) -> Audit:
    """One audit per session, table folder and corpus: its settled tables are shared by the queries."""
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
    if key not in _AUDITS:
        _AUDITS[key] = Audit(_files(spark, sf_dir, build))
    return _AUDITS[key]


def entry(spark: SparkSession) -> DataFrame:
    """Scorecard of every project: score, status, strategy and metrics."""
    a = _audit(spark, "/root/testdata/sf0.001")
    return a.project_scores.join(a.strategies, "project").join(a.project_metrics, "project").orderBy("project")


REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, twin: str | None = None):
    def keep(function: Query) -> Query:
        assert name not in REGISTRY, name
        REGISTRY[name] = (function, twin)
        return function
    return keep


HIT = "project, file_path, rule_id, line_start, line_end, code_snippet"
C = F.col

# --- sources -----------------------------------------------------------------------------------


def _per_project(df: DataFrame) -> DataFrame:
    return df.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("chars"))


@register("S01_source_files", o.q("", "SELECT project, count(*) AS files, sum(length(content)) AS chars FROM code GROUP BY project", o.TREE))
def _(spark, d):
    return _per_project(fs.ignore_paths(_tree(spark, d)).filter(fs.is_code(C("file_path"))))


@register("S02_sql_files", o.q("", "SELECT project, count(*) AS files, sum(length(content)) AS chars FROM sqlf GROUP BY project", o.TREE))
def _(spark, d):
    return _per_project(fs.ignore_paths(_tree(spark, d)).filter(fs.is_sql(C("file_path"))))


@register("S03_ignore_paths", o.q("", "SELECT project, file_path, length(content) AS chars FROM rel WHERE NOT regexp_matches(rel, '" + o.IGNORED + "')", o.TREE))
def _(spark, d):
    return fs.ignore_paths(_tree(spark, d)).select("project", "file_path", F.length("content").alias("chars"))


_HINTS = o.values([(h, i) for i, h in enumerate(rb.BACKEND_HINTS)], "hint, r", "h")
_BACKEND = f"""best AS (SELECT r.project, arg_min(h.hint, h.r) AS hint FROM rel r JOIN {_HINTS} h ON starts_with(r.rel, h.hint || '/') GROUP BY r.project),
kept AS (SELECT r.project, r.file_path, CASE WHEN b.hint IS NULL THEN r.root ELSE r.root || '/' || b.hint END AS root
         FROM rel r LEFT JOIN best b USING (project) WHERE b.hint IS NULL OR starts_with(r.rel, b.hint || '/'))"""


@register("S04_backend_root", o.q(_BACKEND, "SELECT project, root, file_path FROM kept", o.TREE))
def _(spark, d):
    return fs.select_backend_root(fs.source_files(_tree(spark, d))).select("project", "root", "file_path")


@register("S05_file_roles", o.q("", "SELECT project, file_path, concat_ws(',', " + ", ".join(
    f"CASE WHEN lower(file_path) LIKE '%/{r}/%' THEN '{r}' END" for r in rb.ROLE_FOLDERS) + ") AS roles FROM code", o.TREE))
def _(spark, d):
    kept = fs.ignore_paths(_tree(spark, d))
    return fs.file_roles(kept).withColumn("roles", F.array_join("roles", ","))


@register("S06_orm_tags", o.q("", """SELECT DISTINCT project, orm FROM (
  SELECT project, unnest([CASE WHEN lower(file_path) LIKE '%prisma%' THEN 'Prisma' END,
    CASE WHEN lower(file_path) LIKE '%mongoose%' OR lower(file_path) LIKE '%model%' THEN 'Mongoose' END,
    CASE WHEN lower(file_path) LIKE '%sequelize%' THEN 'Sequelize' END]) AS orm FROM code) z WHERE orm IS NOT NULL""", o.TREE))
def _(spark, d):
    return fs.orm_tags(fs.ignore_paths(_tree(spark, d)))


@register("S07_discovery_candidates", o.q("", f"SELECT project, file_path, {o._CAND} AS candidate_rank FROM code", o.TREE))
def _(spark, d):
    return fs.discovery_candidates(fs.ignore_paths(_tree(spark, d)))


@register("S08_files_scanned", o.q("", "SELECT project, count(*) AS files_scanned FROM files GROUP BY project"))
def _(spark, d):
    return fs.files_scanned(_audit(spark, d).files)


@register("S13_bad_files", o.q("", "SELECT project, file_path, 'unbalanced brackets' AS reason FROM code WHERE file_path LIKE '%/m24/%'", o.EDGE))
def _(spark, d):
    return _audit(spark, d, corpus.edge_corpus).bad_files


# --- token job -----------------------------------------------------------------------------------

_TOKEN_SUMS = "count(*) AS n_tokens, sum(n * length(t)) AS weighted, max(pos) AS last_pos, max(line) AS last_line"


def _token_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("project", "file_path").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(C("n") * F.length("t")).alias("weighted"),
        F.max("pos").alias("last_pos"), F.max("line").alias("last_line"))


def _code(spark, d, build=corpus.code_corpus) -> DataFrame:
    return _audit(spark, d, build).files.filter(fs.is_code(C("file_path")))


@register("T01_tokens", o.q(o.TOKENS, f"SELECT project, file_path, {_TOKEN_SUMS} FROM tk GROUP BY ALL"))
def _(spark, d):
    return _token_sums(tokens.tokens(_code(spark, d)))


@register("T01_tokens_of_prose", o.q(o.TOKENS, f"SELECT project, file_path, {_TOKEN_SUMS} FROM tk GROUP BY ALL", o.PROSE))
def _(spark, d):
    return _token_sums(tokens.tokens(_code(spark, d, corpus.prose_corpus)))


@register("T02_brackets", o.q(o.TOKENS, "SELECT project, file_path, t AS bracket, open_n, close_n, lvl FROM pairs"))
def _(spark, d):
    return tokens.brackets(_code(spark, d))


@register("T03_member_calls", o.q(o.CALLS, "SELECT project, file_path, open_n, close_n, name, start, stop FROM calls"))
def _(spark, d):
    return tokens.member_calls(_code(spark, d)).drop("names", "line")


@register("T04_call_prefixes", o.q(o.CALLS, "SELECT project, file_path, open_n, array_to_string(names, ' -> ') AS names FROM names"))
def _(spark, d):
    return tokens.member_calls(_code(spark, d)).select(
        "project", "file_path", "open_n", F.array_join("names", " -> ").alias("names"))


_INTEREST = o.words(tokens.CALL_NAMES_OF_INTEREST)


@register("T05_first_arguments", o.q(o.CALLS, f"""SELECT project, file_path, open_n AS n, name, arg0_text,
  CASE WHEN arg0_text IS NULL THEN NULL WHEN regexp_full_match(arg0_text, '"[^"]*"') THEN 'string' WHEN regexp_full_match(arg0_text, '\\d+') THEN 'number'
       WHEN regexp_full_match(arg0_text, '[A-Za-z_$][\\w$]*') THEN 'identifier' WHEN regexp_full_match(arg0_text, '[A-Za-z_$][\\w$.]*') THEN 'member'
       WHEN starts_with(arg0_text, '{{') THEN 'object' ELSE 'expression' END AS arg0_kind
  FROM calls WHERE list_has_any(names, [{_INTEREST[1:-1]}])"""))
def _(spark, d):
    return _audit(spark, d).facts.filter("fact = 'call'").select("project", "file_path", "n", "name", "arg0_kind", "arg0_text")


_STORED: dict[tuple, Audit] = {}


@register("T05_first_arguments_of_stored_files", REGISTRY["T05_first_arguments"][1])
def _(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        table = f"leafscan_{uuid.uuid4().hex}"
        _STORED[key] = Audit(fs.store(_files(spark, d, corpus.code_corpus), table, f"{shared_folder(spark)}/leafscan/{table}"))
    return _STORED[key].facts.filter("fact = 'call'").select("project", "file_path", "n", "name", "arg0_kind", "arg0_text")


@register("T06_object_properties", o.q(o.PROPS, """SELECT p.project, p.file_path, p.call_n AS parent, p.name, p.start, p.stop,
  substr(c.content, p.start + 1, p.stop - p.start) AS text FROM props p JOIN code c USING (project, file_path)"""))
def _(spark, d):
    return _audit(spark, d).facts.filter("fact = 'prop' AND owner = 'arg'").select(
        "project", "file_path", "parent", "name", "start", "stop", "text")


@register("T07_declarators", o.q(o.DECLARATORS, "SELECT project, file_path, text, start, stop, line_start, line_end FROM declarators"))
def _(spark, d):
    return _audit(spark, d).facts.filter("fact = 'declarator'").select(
        "project", "file_path", "text", "start", "stop", "line_start", "line_end")


# --- rules ---------------------------------------------------------------------------------------

@register("Q00_sql_flags", o.q(o.SQL_FLAGS, "SELECT * EXCLUDE (content) FROM flags"))
def _(spark, d):
    return text_rules.sql_flags(_audit(spark, d).files)


@register("Q00_sql_flags_of_prose", o.q(o.SQL_FLAGS, "SELECT * EXCLUDE (content) FROM flags", o.PROSE))
def _(spark, d):
    return text_rules.sql_flags(_audit(spark, d, corpus.prose_corpus).files)


@register("QGW_hits_of_prose", o.q(o.SQL_HITS + "," + o.GRAPHQL_HITS + "," + o.WRAPPER_HITS, f"""SELECT project, file_path, rule_id, line_start, code_snippet
  FROM (SELECT {o.HIT_COLS} FROM sql_hits UNION ALL SELECT {o.HIT_COLS} FROM g_hits UNION ALL SELECT {o.HIT_COLS} FROM w_hits) z""", o.PROSE))
def _(spark, d):
    files = _audit(spark, d, corpus.prose_corpus).files
    hits = text_rules.hit_rows(text_rules.text_facts(files, ("Q", "G", "W")))
    return hits.select("project", "file_path", "rule_id", "line_start", "code_snippet")


@register("G00_graphql_words", o.q(o.GRAPHQL, "SELECT project, file_path, has_first, has_after, has_min FROM gq"))
def _(spark, d):
    return text_rules.graphql_idents(_audit(spark, d).files)


@register("W00_wrapper_sites", o.q(o.WRAPPERS, "SELECT project, file_path, line, context AS code_snippet FROM sites"))
def _(spark, d):
    return text_rules.wrapper_sites(_audit(spark, d).files)


def _rule_query(rule: str, hits: Callable[[SparkSession, str], DataFrame], ctes: str, source: str) -> None:
    extra = {"A01": ", evidence", "G01": ", strategy_seen"}.get(rule, "")
    twin = o.q(ctes, f"SELECT {HIT}{extra} FROM {source} WHERE rule_id = '{rule}'")

    def query(spark, d):
        return hits(spark, d).filter(C("rule_id") == rule).select(*[x.strip() for x in (HIT + extra).split(",")])

    code = next(r[2] for r in rb.RULE_TEXTS if r[0] == rule).lower()
    register(f"{rule}_{code}", twin)(query)


for _rule in ("Q01", "Q02", "Q03", "Q04", "Q05", "Q06", "Q07"):
    _rule_query(_rule, lambda s, d: text_rules.sql_hits(_audit(s, d).files), o.SQL_HITS, "sql_hits")
for _rule in ("A01", "A02", "A03", "A04", "A05", "A10"):
    _rule_query(_rule, lambda s, d: js_rules.chain_hits(_audit(s, d).facts), o.JS_HITS, "js_hits")
for _rule in ("A06", "A07", "A08", "A09"):
    _rule_query(_rule, lambda s, d: js_rules.object_hits(_audit(s, d).facts), o.JS_HITS, "js_hits")
_rule_query("A11", lambda s, d: js_rules.declarator_hits(_audit(s, d).facts), o.JS_HITS, "js_hits")
_rule_query("A12", lambda s, d: js_rules.page_size_hits(text_rules.hit_rows(_audit(s, d).text_facts), _audit(s, d).facts), o.JS_HITS, "js_hits")
for _rule in ("G01", "G02"):
    _rule_query(_rule, lambda s, d: text_rules.graphql_hits(_audit(s, d).files), o.GRAPHQL_HITS, "g_hits")
for _rule in ("W01", "W02"):
    _rule_query(_rule, lambda s, d: text_rules.wrapper_hits(_audit(s, d).files), o.WRAPPER_HITS, "w_hits")


@register("A13_capped_files", o.q("", f"SELECT project, file_path FROM code WHERE {o.CAP}"))
def _(spark, d):
    return js_rules.capped_files(_audit(spark, d).facts)


# Expected hits and entry points of the edge shapes, by shape number: rule, lines, text.
EDGE_HITS = (
    (0, "A01", 5, 5, "this.m.find().skip(q.n).limit(5)"), (0, "A03", 5, 5, "this.m.find().skip(q.n).limit(5)"),
    (0, "A01", 5, 5, "this.m.find().skip(q.n)"), (0, "A02", 5, 5, "this.m.find().skip(q.n)"), (0, "A03", 5, 5, "this.m.find().skip(q.n)"),
    (2, "A06", 1, 1, 'M.findAll({ offset, limit, order: [["id"]] })'),
    (3, "A01", 2, 2, 'M.find()["skip"](20000).limit(5)'), (3, "A03", 2, 2, 'M.find()["skip"](20000).limit(5)'),
    (3, "A01", 2, 2, 'M.find()["skip"](20000)'), (3, "A02", 2, 2, 'M.find()["skip"](20000)'),
    (3, "A03", 2, 2, 'M.find()["skip"](20000)'), (3, "A04", 2, 2, 'M.find()["skip"](20000)'),
    (5, "A01", 1, 1, "new Q(a).skip(3)"), (5, "A02", 1, 1, "new Q(a).skip(3)"), (5, "A03", 1, 1, "new Q(a).skip(3)"),
    (6, "A01", 1, 1, "(a + b).skip(2).sort(x)"), (6, "A02", 1, 1, "(a + b).skip(2).sort(x)"),
    (6, "A01", 1, 1, "(a + b).skip(2)"), (6, "A02", 1, 1, "(a + b).skip(2)"), (6, "A03", 1, 1, "(a + b).skip(2)"),
    (7, "A01", 1, 1, "M.find().skip(0).limit(20000)"), (7, "A03", 1, 1, "M.find().skip(0).limit(20000)"),
    (7, "A04", 1, 1, "M.find().skip(0).limit(20000)"),
    (7, "A01", 1, 1, "M.find().skip(0)"), (7, "A02", 1, 1, "M.find().skip(0)"), (7, "A03", 1, 1, "M.find().skip(0)"),
    (8, "A01", 1, 1, "M.find().offset(20000)"), (8, "A02", 1, 1, "M.find().offset(20000)"), (8, "A03", 1, 1, "M.find().offset(20000)"),
    (9, "A01", 1, 1, 'M.find().skip(page * size + 1).limit(9).order("id")'),
    (9, "A01", 1, 1, "M.find().skip(page * size + 1).limit(9)"), (9, "A03", 1, 1, "M.find().skip(page * size + 1).limit(9)"),
    (9, "A01", 1, 1, "M.find().skip(page * size + 1)"), (9, "A02", 1, 1, "M.find().skip(page * size + 1)"),
    (9, "A03", 1, 1, "M.find().skip(page * size + 1)"),
    (10, "A01", 1, 1, "M.find().skip((page - 1) * (size || 10)).limit(9)"), (10, "A03", 1, 1, "M.find().skip((page - 1) * (size || 10)).limit(9)"),
    (10, "A01", 1, 1, "M.find().skip((page - 1) * (size || 10))"), (10, "A02", 1, 1, "M.find().skip((page - 1) * (size || 10))"),
    (10, "A03", 1, 1, "M.find().skip((page - 1) * (size || 10))"), (10, "A05", 1, 1, "M.find().skip((page - 1) * (size || 10))"),
    (13, "A12", 1, 1, ""), (15, "A11", 2, 2, "pageSize = +req.query.pageSize"), (15, "A12", 1, 1, ""),
    (16, "A01", 2, 2, "M.find().sort(sortBy).skip(2).limit(3)"), (16, "A01", 2, 2, "M.find().sort(sortBy).skip(2)"),
    (16, "A02", 2, 2, "M.find().sort(sortBy).skip(2)"), (16, "A10", 3, 3, "M.find().order(req.query.order[0])"),
    (18, "A09", 2, 2, "db.p.findMany({ where: { a: 1 } })"),
    (20, "A01", 1, 1, "db.p.findMany(args).skip(1)"), (20, "A02", 1, 1, "db.p.findMany(args).skip(1)"), (20, "A03", 1, 1, "db.p.findMany(args).skip(1)"),
    (21, "A01", 1, 1, "z.m(w.n().o()).skip(4)"), (21, "A02", 1, 1, "z.m(w.n().o()).skip(4)"), (21, "A03", 1, 1, "z.m(w.n().o()).skip(4)"),
)
EDGE_UNITS = (
    (0, "nest-http", "GET list (list)", 3, 6, "list"), (0, "nest-http", "POST / (create)", 8, 9, "create"),
    (1, "nest-graphql", "Query.cats", 2, 4, "all"), (1, "nest-graphql", "Mutation.add", 5, 8, "add"),
    (22, "graphql", "Mutation.add", 2, 2, "addUser"), (22, "graphql", "Mutation.del", 2, 2, "del"), (22, "graphql", "Query.list", 4, 4, None),
    (23, "http", "POST /a", 2, 2, None), (23, "http", "GET k", 3, 3, None), (23, "http", "DELETE /b", 5, 7, None), (23, "http", "GET /c", 8, 8, "h"),
)
_SHAPE = "CAST(regexp_extract(c.file_path, '/m([0-9]+)/', 1) AS INT)"


@register("A_hits_of_edge_shapes", o.q("", f"""SELECT c.project, c.file_path, v.rule_id, v.line_start, v.line_end, v.code_snippet
  FROM code c JOIN {o.values(EDGE_HITS, 'k, rule_id, line_start, line_end, code_snippet', 'v')} v ON v.k = {_SHAPE}""", o.EDGE))
def _(spark, d):
    return _audit(spark, d, corpus.edge_corpus).raw_findings.select(*[x.strip() for x in HIT.split(",")])


def _edge_units(name: str, kinds: tuple[str, ...], build) -> None:
    twin = o.q("", f"""SELECT c.project, c.file_path AS entry_file, v.kind, v.name, v.entry_start, v.entry_end, v.entry_symbol
      FROM code c JOIN {o.values([u for u in EDGE_UNITS if u[1] in kinds], 'k, kind, name, entry_start, entry_end, entry_symbol', 'v')} v
      ON v.k = {_SHAPE}""", o.EDGE)

    def query(spark, d):
        return build(_audit(spark, d, corpus.edge_corpus).facts).select(
            "project", "entry_file", "kind", "name", "entry_start", "entry_end", "entry_symbol")

    register(name, twin)(query)


_edge_units("U01_http_units_of_edge_shapes", ("http",), discovery.http_units)
_edge_units("U02_graphql_units_of_edge_shapes", ("graphql",), discovery.graphql_units)
_edge_units("U03_nest_http_units", ("nest-http",), discovery.nest_http_units)
_edge_units("U04_nest_graphql_units", ("nest-graphql",), discovery.nest_graphql_units)
_edge_units("X03_discovered_units_of_edge_shapes", ("http", "graphql", "nest-http", "nest-graphql"), discovery.discovered_units)

_CORPUS_UNITS = o.CALLS + "," + o.UNITS
_UNIT_COLS = ("project", "unit_key", "unit_id", "kind", "name", "entry_file", "entry_start", "entry_end", "entry_symbol")


# --- files that need modes, modules that pass names on ---------------------------------------------

_SUPPLIED = "'m' || s_suppkey % 10 AS project, '/m' || s_suppkey % 10 || '/k' || s_suppkey || '/' || path AS file_path"


def _supplied(rows: list[tuple], columns: str, shown: str) -> str:
    """Rows that hold for every supplier's files."""
    return f"SELECT {_SUPPLIED}, {shown} FROM supplier, {o.values(rows, columns, 'v')}"


@register("T04_calls_in_modes", _supplied([
    ("modes/template.ts", "find", 1), ("modes/template.ts", "find -> skip", 1), ("modes/template.ts", "list", 1), ("modes/template.ts", "list -> offset", 1), ("modes/template.ts", "done", 2),
    ("modes/markup.tsx", "find", 1), ("modes/markup.tsx", "find -> skip", 1), ("modes/markup.tsx", "find", 2), ("modes/markup.tsx", "find -> skip", 2),
    ("modes/types.ts", "find", 1), ("modes/types.ts", "find -> skip", 1), ("modes/types.ts", "list", 2), ("modes/types.ts", "list -> skip", 2), ("modes/types.ts", "pick", 3), ("modes/types.ts", "h", 4),
    ("modes/open.ts", "find", 1), ("modes/open.ts", "find -> skip", 1), ("modes/open.ts", "find", 6), ("modes/open.ts", "find -> skip", 6),
    ("modes/loose.ts", "find", 2), ("modes/loose.ts", "find -> skip", 2), ("modes/loose.ts", "find", 4), ("modes/loose.ts", "find -> limit", 4),
    ("modes/stray.ts", "find", 1), ("modes/stray.ts", "find -> skip", 1), ("modes/stray.ts", "find", 3), ("modes/stray.ts", "find -> skip", 3),
    ("modes/groups.ts", "find", 1), ("modes/groups.ts", "find -> skip", 1), ("modes/groups.ts", "list", 2), ("modes/groups.ts", "list -> sort", 2), ("modes/groups.ts", "list -> sort -> skip", 3),
    ("modes/groups.ts", "find", 4), ("modes/groups.ts", "skip", 4), ("modes/groups.ts", "skip", 5)], "path, names, line", "names, line"))
def _(spark, d):
    files = _files(spark, d, corpus.module_corpus).filter(C("file_path").contains("/modes/"))
    return tokens.member_calls(files).select("project", "file_path", F.array_join("names", " -> ").alias("names"), "line")


GROUPED_HITS = [("modes/groups.ts", rule, first, last, text) for rules, first, last, text in (
    ("A01 A02 A03", 1, 1, "(M.find({a: #})).skip(5)"), ("A01 A02", 2, 3, "((N.list()).sort(b)\n).skip(5)"),
    ("A01 A02 A03", 4, 4, "(await P.find()).skip(6)"), ("A01 A02 A03", 5, 5, "(Q?.find()).skip(7)")) for rule in rules.split()]


@register("A_hits_behind_groups", _supplied(GROUPED_HITS, "path, rule_id, line_start, line_end, shown", "rule_id, line_start, line_end, replace(shown, '#', s_suppkey::VARCHAR) AS code_snippet"))
def _(spark, d):
    hits = _audit(spark, d, corpus.module_corpus).raw_findings.filter(C("file_path").endswith("/modes/groups.ts"))
    return hits.select(*[x.strip() for x in HIT.split(",")])


@register("S13_broken_statements", _supplied([
    ("modes/open.ts", 2, 5), ("modes/loose.ts", 1, 1), ("modes/loose.ts", 3, 3), ("modes/stray.ts", 2, 2), ("modes/stray.ts", 2, 2)], "path, line_start, line_end", "line_start, line_end"))
def _(spark, d):
    return _audit(spark, d, corpus.module_corpus).facts.filter("fact = 'bad'").select("project", "file_path", "line_start", "line_end")


@register("U05_chains_between_modules", _supplied([
    ("impl/store.ts", "GET /list", 0, "list", 1), ("impl/store.ts", "GET /list", 1, "inner", 2), ("impl/store.ts", "POST /save", 0, "write", 3), ("default.ts", "PUT /def", 0, "handler", 1),
    ("common.js", "GET /old", 0, "old", 1), ("common.js", "GET /k", 0, "hidden", 2), ("whole.js", "GET /whole", 0, "main", 1), ("far/d.ts", "GET /far", 0, "deep", 1),
    ("impl/store.ts", "GET /aliased", 0, "aliased", 5), ("shadow/a.ts", "GET /param", 0, "param", 2), ("shadow/a.ts", "GET /inner", 0, "inner", 3), ("impl/other.ts", "GET /inner", 1, "put", 2),
    ("shadow/a.ts", "GET /arrow", 0, "arrow", 4), ("shadow/a.ts", "GET /arrow", 1, "own", 5)], "path, name, depth, symbol, line", "CASE WHEN name = 'GET /list' THEN name || s_suppkey ELSE name END AS name, depth, symbol, line"))
def _(spark, d):
    units = _audit(spark, d, corpus.module_corpus).discovered
    return units.select("project", "name", F.posexplode("call_chain").alias("depth", "step")).select("project", "step.file_path", "name", "depth", "step.symbol", "step.line")


@register("U01_http_units", o.q(_CORPUS_UNITS, f"SELECT {', '.join(_UNIT_COLS)} FROM disc WHERE kind = 'http'"))
def _(spark, d):
    return discovery.http_units(_audit(spark, d).facts).select(*_UNIT_COLS)


@register("U02_graphql_units", o.q(_CORPUS_UNITS, f"SELECT {', '.join(_UNIT_COLS)} FROM disc WHERE kind = 'graphql'"))
def _(spark, d):
    return discovery.graphql_units(_audit(spark, d).facts).select(*_UNIT_COLS)


@register("U05_call_chains", o.q(_CORPUS_UNITS, "SELECT project, unit_key, depth, file_path, symbol, line FROM steps"))
def _(spark, d):
    return callchain.call_steps(_audit(spark, d).discovered)


@register("J07_call_edges", o.q(_CORPUS_UNITS, "SELECT project, from_file, from_symbol, to_file AS next_file, symbol AS next_symbol, line AS next_line FROM edge"))
def _(spark, d):
    a = _audit(spark, d)
    return callchain.call_edges(a.facts, callchain.declarations(a.facts), callchain.bound_names(a.facts))


# --- findings: union, signals, enrichment, dedupe ------------------------------------------------

_FIND = "project, file_path, code, severity, message, line_start, line_end, code_snippet, strategy, root_cause, recommendation, evidence"
_FIND_COLS = [x.strip() for x in _FIND.split(",")]


@register("X01_raw_findings", o.q(o.RAW, f"SELECT {_FIND} FROM raw"))
def _(spark, d):
    return _audit(spark, d).raw_findings.select(*_FIND_COLS)


@register("X02_final_findings", o.q(o.ENRICHED, f"SELECT {_FIND} FROM final"))
def _(spark, d):
    return _audit(spark, d).final_findings.select(*_FIND_COLS)


@register("N01_deduped_findings", o.q(o.RAW, f"""SELECT {_FIND} FROM raw
  QUALIFY row_number() OVER (PARTITION BY project, code, file_path, message ORDER BY {o.ORD}) = 1"""))
def _(spark, d):
    return fd.dedupe_findings(_audit(spark, d).raw_findings).select(*_FIND_COLS)


@register("M01_signals", o.q(o.RAW + "," + o.SIGNALS, """SELECT project, has_offset, has_cursor, has_offset OR has_cursor OR paginated AS has_any_pagination,
  files_with_cap, files_without_cap, unbounded_endpoints FROM signals"""))
def _(spark, d):
    return _audit(spark, d).signals


for _rule, _code_name in (("M02", "inconsistent_page_size"), ("M03", "multiple_unbounded"), ("M04", "concurrent_writes"), ("M05", "order_without_index")):
    def _enriched(spark, d, rule=_rule):
        rows = enrich.project_findings(_audit(spark, d).raw_findings)
        return rows.filter(C("rule_id") == rule).select("project", "file_path", "code", "severity", "message")

    register(f"{_rule}_{_code_name}", o.q(o.ENRICHED, f"SELECT project, file_path, code, severity, message FROM allf WHERE rule_id = '{_rule}'"))(_enriched)


@register("M06_detected_strategy", o.q(o.ENRICHED, """SELECT project, CASE WHEN oo AND cc THEN 'mixed' WHEN oo THEN 'offset' WHEN cc THEN 'cursor' ELSE 'none' END AS detected_strategy
  FROM (SELECT project, bool_or(coalesce(strategy = 'offset', false) OR code = 'OFFSET_USED') AS oo,
        bool_or(coalesce(strategy = 'cursor', false) OR code = 'UNSTABLE_CURSOR') AS cc FROM final GROUP BY project) z"""))
def _(spark, d):
    return _audit(spark, d).strategies


# --- grouping ------------------------------------------------------------------------------------

_PRESET = o.ENRICHED + "," + o.UNITS + "," + f"""
wanted AS (SELECT f.*, CASE WHEN f.code = 'NO_PAGE_SIZE_CAP' AND f.file_path LIKE '%/utils/w%'
             THEN 'http:get:/x' || regexp_extract(f.file_path, '(\\d+)\\.ts$', 1) || ':/' || f.project || '/src/routes/x' || regexp_extract(f.file_path, '(\\d+)\\.ts$', 1) || '.ts:3' END AS unit_id FROM final f)"""


@register("J01_preset_units", o.q(_PRESET, """SELECT w.project, w.file_path, w.code, w.unit_id, coalesce(d.unit_key, 'file:' || w.file_path) AS unit_key
  FROM wanted w LEFT JOIN disc d ON d.project = w.project AND d.unit_id = w.unit_id WHERE w.unit_id IS NOT NULL"""))
def _(spark, d):
    a = _audit(spark, d)
    number = F.regexp_extract("file_path", r"(\d+)\.ts$", 1)
    wanted = F.when((C("code") == "NO_PAGE_SIZE_CAP") & C("file_path").contains("/utils/w"), F.concat(
        F.lit("http:get:/x"), number, F.lit(":/"), "project", F.lit("/src/routes/x"), number, F.lit(".ts:3")))
    preset = a.final_findings.withColumn("unit_id", wanted)
    return grouping.group_findings(preset, a.discovered).filter("unit_id IS NOT NULL").select(
        "project", "file_path", "code", "unit_id", "unit_key")


def _assigned(name: str, how: str) -> None:
    def query(spark, d):
        return _audit(spark, d).findings.filter(C("assigned_by") == how).select(
            "project", "file_path", "code", "message", "unit_key")

    register(name, o.q(o.GROUPED, f"SELECT project, file_path, code, message, unit_key FROM grouped WHERE assigned_by = '{how}'"))(query)


_assigned("J02_units_by_line", "file")
_assigned("J03_units_by_chain", "chain")


@register("J04_file_units", o.q(o.GROUPED, "SELECT project, unit_key, kind, name FROM units WHERE ugrp = 1"))
def _(spark, d):
    a = _audit(spark, d)
    return grouping.file_units(a.findings, a.projects).select("project", "unit_key", "kind", "name")


@register("J05_all_units", o.q(o.SCORED, "SELECT project, unit_key, issue_count, score FROM us"))
def _(spark, d):
    return _audit(spark, d).unit_scores.select("project", "unit_key", "issue_count", "score")


@register("J06_layers_and_categories", o.q(o.GROUPED, "SELECT project, file_path, code, message, layer, category FROM grouped"))
def _(spark, d):
    return grouping.classify(_audit(spark, d).final_findings).select(
        "project", "file_path", "code", "message", "layer", "category")


@register("J08_unassigned", o.q(o.GROUPED, "SELECT project, file_path, code FROM grouped WHERE unit_key IS NULL"))
def _(spark, d):
    return grouping.unassigned(_audit(spark, d).findings).select("project", "file_path", "code")


@register("N02_unit_findings_deduped", o.q(o.GROUPED, "SELECT project, unit_key, code, file_path, line_start, message, layer, category FROM grouped"))
def _(spark, d):
    return _audit(spark, d).findings.select("project", "unit_key", "code", "file_path", "line_start", "message", "layer", "category")


# --- scores and metrics --------------------------------------------------------------------------

@register("M07_unit_scores", o.q(o.SCORED, f"SELECT project, unit_key, score, {o.status('score')} AS status FROM us"))
def _(spark, d):
    return _audit(spark, d).unit_scores.select("project", "unit_key", "score", "status")


@register("M08_unit_deductions", o.q(o.SCORED, """SELECT project, unit_key, string_agg(code || ':' || points || ':' || reason, ' | ' ORDER BY first_ord) AS deductions
  FROM cp GROUP BY project, unit_key"""))
def _(spark, d):
    text = F.transform("deductions", lambda x: F.concat_ws(":", x["code"], x["points"].cast("string"), x["reason"]))
    return _audit(spark, d).unit_deductions.select("project", "unit_key", F.array_join(text, " | ").alias("deductions"))


@register("M09_unit_categories", o.q(o.SCORED, "SELECT project, unit_key, category, category_score FROM cats"))
def _(spark, d):
    return _audit(spark, d).unit_categories


@register("M10_status_bands", o.q(o.SCORED, f"SELECT project, {o.status('score')} AS status, count(*) AS n_units FROM us GROUP BY ALL"))
def _(spark, d):
    return _audit(spark, d).unit_scores.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n_units"))


@register("M11_unit_weights", o.q(o.SCORED, "SELECT project, unit_key, CAST(weight AS DOUBLE) AS weight FROM us"))
def _(spark, d):
    return _audit(spark, d).unit_scores.select("project", "unit_key", C("weight").cast("double").alias("weight"))


@register("M12_project_scores", o.q(o.SCORED, f"""SELECT r.project, coalesce(p.score, 100) AS score, {o.status('coalesce(p.score, 100)')} AS status
  FROM roots r LEFT JOIN ps p USING (project)"""))
def _(spark, d):
    return _audit(spark, d).project_scores


@register("M13_project_categories", o.q(o.SCORED, """SELECT c.project, c.category, CAST(floor(sum(u.weight * c.category_score) / sum(u.weight) + 0.5) AS INT) AS score
  FROM cats c JOIN us u USING (project, unit_key) GROUP BY ALL"""))
def _(spark, d):
    return _audit(spark, d).project_categories


_COUNTS = [m for m in metrics.METRICS if not m.endswith("percent")]


@register("M14_project_metrics", o.q(o.SCORED, "SELECT r.project, " + ", ".join(
    f"coalesce({m}, 0) AS {m}" if m in _COUNTS else m for m in metrics.METRICS) + " FROM roots r LEFT JOIN pm USING (project)"))
def _(spark, d):
    return _audit(spark, d).project_metrics


@register("M15_issues", o.q(o.GROUPED, f"SELECT project, rank, txt AS issue FROM ({o.first_seen('message')}) y"))
def _(spark, d):
    return _audit(spark, d).issues


@register("M15_root_causes", o.q(o.GROUPED, f"SELECT project, rank, txt AS root_cause FROM ({o.first_seen('root_cause')}) y"))
def _(spark, d):
    return _audit(spark, d).root_causes


_ADVICE = o.GROUPED + ",\nadvice AS (SELECT project, txt, 0 AS part, rank AS i FROM (" + o.first_seen("recommendation") + ") y" + "".join(
    f" UNION ALL SELECT DISTINCT project, {o._cell(text)}, 1, {i} FROM grouped WHERE code IN {o.words(codes)}" for i, (codes, text) in enumerate(rb.GENERAL_ADVICE)) + """),
recs AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY part, i) AS rank, txt AS recommendation FROM (
  SELECT * FROM advice QUALIFY row_number() OVER (PARTITION BY project, txt ORDER BY part, i) = 1) z)"""


@register("M16_recommendations", o.q(_ADVICE, "SELECT project, rank, recommendation FROM recs"))
def _(spark, d):
    return _audit(spark, d).recommendations


def _unit_advice(name: str, column: str) -> None:
    def query(spark, d):
        return metrics.unit_advice(_audit(spark, d).findings, column)

    register(name, o.q(o.GROUPED, f"""SELECT project, unit_key, rank, txt AS text
      FROM ({o.first_seen(column, keys='project, unit_key')}) y WHERE rank <= 8"""))(query)


_unit_advice("M17_unit_root_causes", "root_cause")
_unit_advice("M17_unit_recipes", "recommendation")

# --- ranks, views, decisions ---------------------------------------------------------------------


@register("N03_report_findings", o.q(o.GROUPED, f"""SELECT project, file_path, code, message, severity FROM (
  SELECT * FROM grouped WHERE file_path <> '<project>' QUALIFY row_number() OVER (PARTITION BY project, code, file_path ORDER BY sev DESC, {o.ORD}) = 1
  UNION ALL SELECT * FROM grouped WHERE file_path = '<project>') z"""))
def _(spark, d):
    return metrics.report_findings(_audit(spark, d).findings).select("project", "file_path", "code", "message", "severity")


@register("N04_unit_severity", o.q(o.SCORED, "SELECT project, unit_key, max_severity, primary_risk FROM us WHERE issue_count > 0"))
def _(spark, d):
    return _audit(spark, d).unit_scores.filter("issue_count > 0").select(
        "project", "unit_key", "max_severity", C("primary.message").alias("primary_risk"))


_TOP = """SELECT * FROM (SELECT project, unit_key, name, kind, score, max_severity, issue_count, primary_risk,
    coalesce(entry_file, primary_file) AS entry_file, coalesce(entry_start, CASE WHEN primary_file <> '<project>' THEN primary_line END) AS entry_line,
    row_number() OVER (PARTITION BY project ORDER BY coalesce(max_rank, -1) DESC, score, issue_count DESC, name, ugrp, cand, entry_file, kind_rank, n) AS rank FROM us) z WHERE rank <= 5"""


@register("K01_top_units", o.q(o.SCORED, _TOP))
def _(spark, d):
    return _audit(spark, d).top_units.drop("unit_id", "status")


def _view(name: str, scope: str, sort: str, only: str, keep: str) -> None:
    category = {"bounds": "Bounds", "depth": "DepthCost"}.get(sort)
    value = "u.score" if category is None else "coalesce(c.category_score, u.score)"
    where = "u.score < 75 OR u.high" if scope == "critical" else "true"
    twin = o.q(o.SCORED, f"""SELECT project, unit_key, score, sort_value, row_number() OVER (PARTITION BY project ORDER BY sort_value, rank DESC, score, ugrp, cand, entry_file, kind_rank, n) AS position FROM (
      SELECT u.project, u.unit_key, u.score, {value} AS sort_value, {keep} AS keep, bool_or({keep}) OVER (PARTITION BY u.project) AS matched,
        coalesce(u.max_rank, 0) AS rank, u.ugrp, u.cand, u.entry_file, u.kind_rank, u.n
      FROM us u LEFT JOIN cats c ON c.project = u.project AND c.unit_key = u.unit_key AND c.category = '{category}' WHERE {where}) z WHERE keep OR NOT matched""")

    def query(spark, d):
        a = _audit(spark, d)
        return metrics.order_view(metrics.unit_view(a.unit_scores, a.unit_categories, scope, sort, only)).select("project", "unit_key", "score", "sort_value", "position")

    register(name, twin)(query)


_view("K02_critical_units_by_score", "critical", "score", "high", "coalesce(u.max_rank, 0) >= 2")
_view("K02_critical_units_by_bounds", "critical", "bounds", "critical", "coalesce(u.max_rank, 0) = 3")
_view("K02_all_units_by_depth", "all", "depth", "deepOffset", "u.deep_offset")
_view("K02_all_unbounded_units", "all", "score", "unbounded", "u.unbounded")
_view("K02_all_unsafe_sort_units", "all", "score", "unsafeSort", "u.unsafe_sort")


@register("K03_findings_view", o.q(o.GROUPED, f"""SELECT project, file_path, code, message, severity, section,
  row_number() OVER (PARTITION BY project ORDER BY section, CASE WHEN section = 0 THEN -sev ELSE 0 END, {o.ORD}) AS position FROM (
  SELECT *, 0 AS section FROM grouped WHERE file_path <> '<project>' QUALIFY row_number() OVER (PARTITION BY project, code, file_path ORDER BY sev DESC, {o.ORD}) = 1
  UNION ALL SELECT *, 1 FROM grouped WHERE file_path = '<project>') z"""))
def _(spark, d):
    report = metrics.order_report(metrics.report_findings(_audit(spark, d).findings))
    return report.select("project", "file_path", "code", "message", "severity", "section", "position")


@register("K04_unit_findings", o.q(o.GROUPED, f"""SELECT * FROM (SELECT project, unit_key, code, message,
  row_number() OVER (PARTITION BY project, unit_key ORDER BY sev DESC, {o.ORD}) AS rank FROM grouped) z WHERE rank <= 20"""))
def _(spark, d):
    return metrics.unit_findings(_audit(spark, d).findings).select("project", "unit_key", "code", "message", "rank")


@register("K04_unit_call_steps", o.q(_CORPUS_UNITS, "SELECT project, unit_key, depth, file_path, symbol, line FROM steps WHERE depth < 10"))
def _(spark, d):
    return metrics.unit_call_steps(_audit(spark, d).discovered)


@register("K05_first_issues", o.q(o.GROUPED, f"SELECT project, rank, txt AS issue FROM ({o.first_seen('message')}) y WHERE rank <= 4"))
def _(spark, d):
    return _audit(spark, d).issues.filter("rank <= 4")


@register("D01_gate_severity", o.q(o.GROUPED, "SELECT project, file_path, code, severity, message FROM grouped WHERE sev > 2"))
def _(spark, d):
    return _audit(spark, d).gate_violations.select("project", "file_path", "code", "severity", "message")


def _policy(a: Audit) -> DataFrame:
    """A policy for every project, derived from its name."""
    number = F.regexp_extract("project", r"(\d+)", 1).cast("int")
    return a.projects.select(
        "project", F.element_at(F.array(*[F.lit(s) for s in rb.SEVERITIES]), number % 4 + 1).alias("max_allowed_severity"),
        F.when(number % 3 == 0, "offset").when(number % 3 == 1, "cursor").alias("enforce_strategy"))


_POLICY = """
policy AS (SELECT project, CAST(regexp_extract(project, '(\\d+)', 1) AS INT) AS i FROM roots),
strat AS (SELECT r.project, CASE WHEN oo AND cc THEN 'mixed' WHEN oo THEN 'offset' WHEN cc THEN 'cursor' ELSE 'none' END AS detected_strategy
  FROM roots r LEFT JOIN (SELECT project, bool_or(coalesce(strategy = 'offset', false) OR code = 'OFFSET_USED') AS oo,
        bool_or(coalesce(strategy = 'cursor', false) OR code = 'UNSTABLE_CURSOR') AS cc FROM grouped GROUP BY project) z USING (project)),
verdict AS (SELECT p.project, (SELECT count(*) FROM grouped g WHERE g.project = p.project AND g.sev > p.i % 4) AS violations,
  s.detected_strategy <> 'none' AND ((p.i % 3 = 0 AND s.detected_strategy <> 'offset') OR (p.i % 3 = 1 AND s.detected_strategy <> 'cursor')) AS strategy_violation
  FROM policy p JOIN strat s USING (project))"""


@register("D02_gate_verdicts", o.q(o.GROUPED + "," + _POLICY, "SELECT project, violations, strategy_violation, violations > 0 OR strategy_violation AS failed FROM verdict"))
def _(spark, d):
    a = _audit(spark, d)
    return metrics.gate_verdicts(a.projects, a.findings, a.strategies, _policy(a))


_ACTIONS = o.SCORED + f""",
todo AS (SELECT project, 1 AS i, {o._cell(rb.NEXT_ACTION_UNBOUNDED)} AS action FROM pm WHERE unbounded_units > 0
  UNION ALL SELECT project, 2, {o._cell(rb.NEXT_ACTION_DEEP_OFFSET)} FROM pm WHERE deep_offset_units > 0
  UNION ALL SELECT project, 3, {o._cell(rb.NEXT_ACTION_ORDER)} FROM pm WHERE stable_order_coverage_percent < 100
  UNION ALL SELECT project, 4, {o._cell(rb.NEXT_ACTION_SORT)} FROM pm WHERE unsafe_sort_units > 0)"""


@register("D03_next_actions", o.q(_ACTIONS, "SELECT * FROM (SELECT project, row_number() OVER (PARTITION BY project ORDER BY i) AS rank, action FROM todo) z WHERE rank <= 3"))
def _(spark, d):
    return _audit(spark, d).next_actions


_HOT = o.SCORED + """,
hot AS (SELECT project, 1 AS i, deep_offset_units || ' deep-offset units' AS hotspot FROM pm WHERE deep_offset_units > 0
  UNION ALL SELECT project, 2, unbounded_units || ' unbounded units' FROM pm WHERE unbounded_units > 0
  UNION ALL SELECT project, 3, unsafe_sort_units || ' unsafe-sort units' FROM pm WHERE unsafe_sort_units > 0)"""


@register("D04_hotspots", o.q(_HOT, "SELECT project, row_number() OVER (PARTITION BY project ORDER BY i) AS rank, hotspot FROM hot"))
def _(spark, d):
    return _audit(spark, d).hotspots


# --- functions -----------------------------------------------------------------------------------

@register("F01_layers", o.q("", f"SELECT project, file_path, {o.LAYER} AS layer FROM corpus", o.TREE))
def _(spark, d):
    return _tree(spark, d).select("project", "file_path", tx.infer_layer(C("file_path")).alias("layer"))


@register("F02_severity_ranks", o.q(o.RAW, "SELECT project, sev AS severity_rank, count(*) AS n FROM raw GROUP BY ALL"))
def _(spark, d):
    return _audit(spark, d).raw_findings.groupBy("project", tx.severity_rank(C("severity")).alias("severity_rank")).agg(
        F.count(F.lit(1)).alias("n"))


@register("F03_paths", o.q("", """SELECT project, file_path, rel AS relative, lower(replace(file_path, chr(92), '/')) AS normal,
  list_extract(string_split(file_path, '/'), -1) AS base FROM rel""", o.TREE))
def _(spark, d):
    return _tree(spark, d).select(
        "project", "file_path", tx.relative_path(C("file_path"), C("root")).alias("relative"),
        tx.normal_path(C("file_path")).alias("normal"), tx.base_name(C("file_path")).alias("base"))


@register("F04_texts", o.q("", """SELECT project, file_path, split_part(content, chr(10), 1) AS head,
  CASE WHEN length(content) <= 50 THEN content ELSE substr(content, 1, 49) || '…' END AS cut,
  length(content) - length(replace(content, chr(10), '')) AS newlines FROM corpus""", o.TREE))
def _(spark, d):
    return _tree(spark, d).select(
        "project", "file_path", tx.first_line(C("content")).alias("head"), tx.truncate(C("content"), 50).alias("cut"),
        tx.count_newlines(C("content")).alias("newlines"))


# --- sinks and reports ---------------------------------------------------------------------------

@register("S09_audit_json_lines", o.q(o.SCORED, """SELECT project, 'report' AS section, 1 AS n FROM roots
  UNION ALL SELECT project, 'finding', count(*) FROM grouped GROUP BY project UNION ALL SELECT project, 'unit', count(*) FROM us GROUP BY project"""))
def _(spark, d):
    return reports.audit_json(_audit(spark, d)).filter(F.length("json") > 0).groupBy("project", "section").agg(F.count(F.lit(1)).alias("n"))


@register("S09_audit_json_scores", o.q(o.SCORED, f"""SELECT r.project, coalesce(p.score, 100) AS score, {o.status('coalesce(p.score, 100)')} AS status,
  coalesce(m.unbounded_units, 0) AS unbounded_units FROM roots r LEFT JOIN ps p USING (project) LEFT JOIN pm m USING (project)"""))
def _(spark, d):
    report = reports.audit_json(_audit(spark, d)).filter("section = 'report'")
    return report.select(
        "project", F.get_json_object("json", "$.score").cast("int").alias("score"), F.get_json_object("json", "$.status").alias("status"),
        F.get_json_object("json", "$.metrics.unboundedUnits").cast("int").alias("unbounded_units"))


@register("S09_audit_json_units", o.q(o.SCORED, """SELECT u.project, u.unit_key AS id, u.kind, u.score, u.entry_file, u.entry_start AS first_line, coalesce(u.entry_end, u.entry_start) AS last_line,
  (SELECT string_agg(c.category || '=' || c.category_score, ',' ORDER BY c.category) FROM cats c WHERE c.project = u.project AND c.unit_key = u.unit_key) AS categories,
  (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT u.entry_file AS f WHERE u.entry_file IS NOT NULL UNION SELECT g.file_path FROM grouped g WHERE g.project = u.project AND g.unit_key = u.unit_key) z) AS files FROM us u"""))
def _(spark, d):
    line = reports.audit_json(_audit(spark, d)).filter("section = 'unit'")
    got = F.from_json("json", "id string, kind string, score int, entry struct<filePath:string,lineRange:array<int>>, files array<string>, categories map<string,int>")
    u = line.select("project", got.alias("u"))
    cats = F.array_join(F.transform(F.sort_array(F.map_entries("u.categories")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return u.select("project", "u.id", "u.kind", "u.score", C("u.entry.filePath").alias("entry_file"), C("u.entry.lineRange")[0].alias("first_line"), C("u.entry.lineRange")[1].alias("last_line"),
                    F.when(F.size("u.categories") > 0, cats).alias("categories"), F.nullif(F.array_join(F.sort_array("u.files"), ","), F.lit("")).alias("files"))


@register("S11_recommendations_of_snapshot", o.q(_ADVICE, "SELECT project, 'listed' AS state, rank, recommendation FROM recs"))
def _(spark, d):
    a = _audit(spark, d)
    path = f"{shared_folder(spark)}/snapshots/{spark.sparkContext.applicationId}/{abs(hash(d))}"
    reports.write_snapshot(a, path, "run-1")
    return reports.read_recommendations(spark, path)


_SUMMARY = _ADVICE.replace(o.GROUPED, _HOT) + f""",
top AS ({_TOP}),
scan AS (SELECT project, count(*) AS files_scanned FROM files GROUP BY project),
hots AS (SELECT project, string_agg(hotspot, ' | ' ORDER BY i) AS hotspots FROM hot GROUP BY project),
iss AS ({o.first_seen('message')})"""


@register("S12_audit_summary", o.q(_SUMMARY + "," + _POLICY, f"""SELECT r.project,
  'Score: ' || coalesce(p.score, 100) || '/100 (' || {o.status('coalesce(p.score, 100)')} || ')' AS headline,
  'Strategy: ' || s.detected_strategy || ' | Files: ' || coalesce(f.files_scanned, 0) AS scope, coalesce(h.hotspots, '') AS hotspots,
  coalesce((SELECT string_agg(t.name || ' [' || coalesce(t.max_severity, 'low') || '] issues=' || t.issue_count || ' @ ' ||
     coalesce(t.entry_file || ':' || t.entry_line, '<unknown>'), chr(10) ORDER BY t.rank) FROM top t WHERE t.project = r.project AND t.rank <= 3), '') AS top,
  coalesce((SELECT string_agg(i.txt, chr(10) ORDER BY i.rank) FROM iss i WHERE i.project = r.project AND i.rank <= 4), '') AS first_issues,
  coalesce((SELECT string_agg(c.recommendation, chr(10) ORDER BY c.rank) FROM recs c WHERE c.project = r.project AND c.rank <= 3), '') AS quick_wins
  FROM roots r LEFT JOIN ps p USING (project) LEFT JOIN strat s USING (project) LEFT JOIN scan f USING (project) LEFT JOIN hots h USING (project)"""))
def _(spark, d):
    return reports.audit_summary(_audit(spark, d))


@register("project_scorecard", o.q(o.SCORED + "," + _POLICY, f"""SELECT r.project, coalesce(p.score, 100) AS score, {o.status('coalesce(p.score, 100)')} AS status, s.detected_strategy,
  coalesce(m.units_scored, 0) AS units_scored, coalesce(m.critical_units, 0) AS critical_units FROM roots r LEFT JOIN ps p USING (project)
  LEFT JOIN strat s USING (project) LEFT JOIN pm m USING (project)"""))
def _(spark, d):
    a = _audit(spark, d)
    return a.project_scores.join(a.strategies, "project").join(
        a.project_metrics.select("project", "units_scored", "critical_units"), "project")


def _optional(module: str):
    """A module that may have been taken out, or None; so it is too where a package that it needs is missing."""
    try:
        return importlib.import_module(module)
    except ImportError:
        return None


def _on_workers(function: Query) -> Query:
    """The query with this folder on the path of the Python workers, wherever the driver was started."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = str(Path(__file__).resolve().parent)
        paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if folder not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([folder, *paths])
        return function(spark, sf_dir)

    return query


def queries() -> dict[str, Query]:
    found = {name: function for name, (function, _) in REGISTRY.items()}
    more = _optional("leafscan.llm.queries")
    if more is not None:
        found |= more.QUERIES
        if (pipeline := _optional("corpus_pipeline")) is not None:
            found["pipeline"] = pipeline.run
    return {name: _on_workers(function) for name, function in found.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: twin for name, (_, twin) in REGISTRY.items() if twin is not None}
    more = _optional("leafscan.llm.queries")
    if more is not None:
        found |= more.ORACLES
        pipeline = _optional("corpus_pipeline")
        if pipeline is not None and pipeline.ORACLE_SQL is not None:
            found["pipeline"] = pipeline.ORACLE_SQL
    return found
