"""DuckDB twins of the registered queries, built from shared common table expressions.

They compute from the same text by other means where that is possible: brackets by ``lead`` per
level, chains and expression heads by recursion, declarators and imports by plain patterns.
"""

from __future__ import annotations

from leafscan import rulebook as rb
from leafscan.sources import corpus as cp


def _cell(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(rows, names: str, alias: str) -> str:
    body = ", ".join("(" + ", ".join(_cell(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {alias}({names}))"


def words(items) -> str:
    return "(" + ", ".join(_cell(i) for i in items) + ")"


CORPUS = cp.CORPUS_SQL.replace("{events}", "events")
PROSE = cp.PROSE_SQL.replace("{documents}", "documents").replace("{pages}", "pages").replace("{conversations}", "conversations")
TREE = cp.TREE_SQL.replace("{documents}", "documents")
EDGE = cp.EDGE_SQL.replace("{customer}", "customer")

TOKEN_RX = (
    r"""(//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/"""
    r"""|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'|`[^`\\]*(?:\\[\s\S][^`\\]*)*`"""
    r"""|[\p{L}_$][\p{L}\p{Nd}_$]*|[0-9][0-9A-Za-z_.]*"""
    r"""|=>|\?\.|\?\?|\.\.\.|\*\*|\+\+|--|&&|\|\||[-+*/%&|^<>=!]=+|\s+|[\s\S])""").replace("'", "''")

IGNORED = r"(^|/)(node_modules|dist|build|\.next|coverage|tests)/|(^|/)[^/]*\.(test|spec)\.[^/]*$|(^|/)\.[^/]|^(node_modules|dist|\.git)$"


def files_ctes(corpus: str = CORPUS) -> str:
    """corpus, files (audited), code, sqlf."""
    return f"""
corpus AS ({corpus}),
rel AS (SELECT *, CASE WHEN starts_with(file_path, rtrim(root, '/') || '/') THEN substr(file_path, length(rtrim(root, '/')) + 2) ELSE file_path END AS rel FROM corpus),
files AS (SELECT * FROM rel WHERE NOT regexp_matches(rel, '{IGNORED}') AND regexp_matches(file_path, '\\.(ts|tsx|js|jsx|sql)$')),
code AS (SELECT * FROM files WHERE NOT file_path LIKE '%.sql'),
sqlf AS (SELECT * FROM files WHERE file_path LIKE '%.sql')"""


FILES = files_ctes()

SQL_FLAGS = r"""
flags AS (SELECT project, file_path, content,
  regexp_matches(content, '(?i)\bLIMIT\b') AS has_limit, regexp_matches(content, '(?i)\bOFFSET\b') AS has_offset,
  regexp_matches(content, '(?i)\bORDER\s+BY\b') AS has_order,
  regexp_matches(content, '(?i)\bROW_NUMBER\s*\(') OR regexp_matches(content, '(?i)\bDENSE_RANK\s*\(') AS has_window,
  regexp_matches(content, '(?i)\bOFFSET\s+\d+\s+ROWS?\s+FETCH\s+NEXT\s+\d+\s+ROWS?\s+ONLY\b') AS has_offset_fetch,
  regexp_matches(content, '(?i)\bSELECT\b') AS has_select,
  regexp_matches(content, '(?i)SELECT\s+\*\s+FROM\s+\w+') AS has_full_scan,
  TRY_CAST(regexp_extract(content, '(?i)\bOFFSET\s+(\d+)\b', 1) AS DOUBLE) AS first_offset
  FROM sqlf)"""

SQL_CONDITIONS = {
    "Q01": "has_offset", "Q02": "has_offset_fetch", "Q03": "has_select AND NOT has_limit",
    "Q04": "has_offset AND NOT has_order", "Q05": "first_offset > 10000",
    "Q06": "has_full_scan AND NOT has_limit", "Q07": "has_window AND NOT has_limit",
}
HIT_COLS = "project, file_path, rule_id, grp, detector, start, stop, line_start, line_end, code_snippet, strategy_seen, evidence"


def _file_hit(rule, cond, source, grp, detector, line="1", snippet="split_part(content, chr(10), 1)", strategy="CAST(NULL AS VARCHAR)", start="0"):
    return (f"SELECT project, file_path, '{rule}' AS rule_id, {grp} AS grp, {detector} AS detector, {start} AS start, 0 AS stop, "
            f"{line} AS line_start, {line} AS line_end, {snippet} AS code_snippet, {strategy} AS strategy_seen, "
            f"CAST(NULL AS VARCHAR) AS evidence FROM {source} WHERE {cond}")


SQL_HITS = SQL_FLAGS + ",\nsql_hits AS (" + " UNION ALL ".join(
    _file_hit(r, c, "flags", 1, 0) for r, c in SQL_CONDITIONS.items()) + ")"

# Tokens: pieces with blanks and comments, then numbered tokens with neighbours and levels.
TOKENS = f"""
pieces AS (SELECT project, file_path, unnest(a) AS t, generate_subscripts(a, 1) AS i
           FROM (SELECT project, file_path, regexp_extract_all(content, '{TOKEN_RX}') AS a FROM code) z),
placed AS (SELECT *, sum(length(t)) OVER w - length(t) AS pos,
             1 + sum(length(t) - length(replace(t, chr(10), ''))) OVER w - (length(t) - length(replace(t, chr(10), ''))) AS line
           FROM pieces WINDOW w AS (PARTITION BY project, file_path ORDER BY i ROWS UNBOUNDED PRECEDING)),
tk AS (SELECT project, file_path, t, CAST(pos AS BIGINT) AS pos, CAST(line AS BIGINT) AS line,
         row_number() OVER w - 1 AS n, lag(t) OVER w AS p1, lag(t, 2) OVER w AS p2, lag(t, 3) OVER w AS p3,
         lead(t) OVER w AS x1, CAST(lag(pos + length(t)) OVER w AS BIGINT) AS prev_end
       FROM placed WHERE NOT regexp_full_match(t, '\\s+') AND NOT starts_with(t, '//') AND NOT (starts_with(t, '/*') AND length(t) > 2)
       WINDOW w AS (PARTITION BY project, file_path ORDER BY i)),
dep AS (SELECT *, sum(CASE WHEN t IN ('(', '[', '{{') THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END)
          OVER (PARTITION BY project, file_path ORDER BY n ROWS UNBOUNDED PRECEDING) AS depth FROM tk),
lv AS (SELECT *, CASE WHEN t IN (')', ']', '}}') THEN depth + 1 ELSE depth END AS lvl FROM dep),
pairs AS (SELECT project, file_path, t, lvl, n AS open_n, pos AS open_pos, p1, p2, p3,
            lead(n) OVER w AS close_n, lead(pos) OVER w AS close_pos, lead(line) OVER w AS close_line
          FROM lv WHERE t IN ('(', '[', '{{', ')', ']', '}}')
          WINDOW w AS (PARTITION BY project, file_path, lvl ORDER BY n) QUALIFY t IN ('(', '[', '{{'))"""

# Member calls, their chain names by recursion over the previous call, their heads by walking back.
CALLS = TOKENS + r""",
mc AS (SELECT project, file_path, open_n, close_n, close_pos, close_line, lvl, p1 AS name, open_n - 3 AS link
       FROM pairs WHERE t = '(' AND p2 = '.' AND regexp_matches(p1, '^[\p{L}_$]')),
names AS (SELECT m.project, m.file_path, m.open_n, m.close_n, [m.name] AS names FROM mc m
          LEFT JOIN mc b ON b.project = m.project AND b.file_path = m.file_path AND b.close_n = m.link
          WHERE b.open_n IS NULL
          UNION ALL
          SELECT m.project, m.file_path, m.open_n, m.close_n, list_append(x.names, m.name)
          FROM names x JOIN mc m ON m.project = x.project AND m.file_path = x.file_path AND m.link = x.close_n),
walk AS (SELECT project, file_path, open_n, open_n - 2 AS dot, CAST(NULL AS BIGINT) AS head FROM mc
         UNION ALL
         SELECT w.project, w.file_path, w.open_n,
           CASE WHEN q.n IS NOT NULL THEN q.n END AS dot,
           CASE WHEN q.n IS NULL THEN coalesce(pr.open_n - CASE WHEN regexp_matches(pr.p1, '^[\p{L}_$]') THEN 1 ELSE 0 END, w.dot - 1) END AS head
         FROM walk w
         LEFT JOIN pairs pr ON pr.project = w.project AND pr.file_path = w.file_path AND pr.close_n = w.dot - 1
         LEFT JOIN tk q ON q.project = w.project AND q.file_path = w.file_path AND q.t = '.'
              AND q.n = coalesce(pr.open_n - 1, w.dot - 1) - 1
         WHERE w.dot IS NOT NULL),
commas AS (SELECT p.project, p.file_path, p.open_n, min(v.n) AS comma_n, min(v.prev_end) AS comma_end
           FROM pairs p JOIN lv v ON v.project = p.project AND v.file_path = p.file_path AND v.t = ',' AND v.lvl = p.lvl
                AND v.n > p.open_n AND v.n < p.close_n GROUP BY ALL),
ends AS (SELECT project, file_path, n, prev_end FROM tk),
calls AS (SELECT m.project, m.file_path, m.open_n, m.close_n, m.name, nm.names, h.pos AS start, m.close_pos + 1 AS stop,
            h.line AS line_start, m.close_line AS line_end, substr(c.content, h.pos + 1, m.close_pos + 1 - h.pos) AS text,
            coalesce(k.comma_n, m.close_n) AS arg0_end_n, a.t AS arg0_first,
            CASE WHEN a.n < m.close_n THEN substr(c.content, a.pos + 1, coalesce(k.comma_end, e.prev_end) - a.pos) END AS arg0_text
          FROM mc m
          JOIN names nm ON nm.project = m.project AND nm.file_path = m.file_path AND nm.open_n = m.open_n
          JOIN walk w ON w.project = m.project AND w.file_path = m.file_path AND w.open_n = m.open_n AND w.head IS NOT NULL
          JOIN tk h ON h.project = m.project AND h.file_path = m.file_path AND h.n = w.head
          JOIN tk a ON a.project = m.project AND a.file_path = m.file_path AND a.n = m.open_n + 1
          JOIN ends e ON e.project = m.project AND e.file_path = m.file_path AND e.n = m.close_n
          JOIN code c ON c.project = m.project AND c.file_path = m.file_path
          LEFT JOIN commas k ON k.project = m.project AND k.file_path = m.file_path AND k.open_n = m.open_n),
ops AS (SELECT p.project, p.file_path, p.open_n, arg_max(v.t, v.n) AS last_op,
          bool_or(v.t NOT IN ('*', '/', '%')) AS weaker
        FROM pairs p JOIN lv v ON v.project = p.project AND v.file_path = p.file_path AND v.lvl = p.lvl
             AND v.n > p.open_n AND v.n < p.close_n AND v.t IN ('*', '/', '%', '+', '-', '<', '>', '=', '?', '&&', '||', '??', '=>', '&', '|')
        GROUP BY ALL)"""

PROPS = CALLS + r""",
objs AS (SELECT p.*, q.open_n AS call_n FROM pairs p
         JOIN pairs q ON q.project = p.project AND q.file_path = p.file_path AND q.open_n = p.open_n - 1 AND q.t = '('
         WHERE p.t = '{' AND q.p2 = '.' AND q.p1 IN ('findMany', 'findAll')),
props AS (SELECT o.project, o.file_path, o.call_n, k.n, k.t AS name, k.pos AS start,
            (SELECT min(b.prev_end) FROM lv b WHERE b.project = o.project AND b.file_path = o.file_path AND b.lvl = o.lvl
               AND b.n > k.n AND b.n <= o.close_n AND (b.t = ',' OR b.n = o.close_n)) AS stop
          FROM objs o JOIN lv k ON k.project = o.project AND k.file_path = o.file_path AND k.lvl = o.lvl
            AND k.n > o.open_n AND k.n < o.close_n AND k.p1 IN ('{', ',') AND k.x1 IN (':', ',', '}') AND regexp_matches(k.t, '^[\p{L}_$]')),
qobj AS (SELECT c.project, c.file_path, c.open_n, any_value(c.start) AS start, any_value(c.stop) AS stop,
           any_value(c.line_start) AS line_start, any_value(c.line_end) AS line_end, any_value(c.text) AS text,
           bool_or(p.name IN ('skip', 'offset')) AS has_skip, bool_or(p.name IN ('take', 'limit')) AS has_take,
           bool_or(p.name IN ('orderBy', 'order')) AS has_order, bool_or(p.name = 'cursor') AS has_cursor,
           bool_or(p.name = 'where') AS has_where,
           coalesce(max(CASE WHEN p.name = 'where' THEN substr(f.content, p.start + 1, p.stop - p.start) END), '') AS where_text
         FROM calls c JOIN props p ON p.project = c.project AND p.file_path = c.file_path AND p.call_n = c.open_n
         JOIN code f ON f.project = c.project AND f.file_path = c.file_path
         GROUP BY c.project, c.file_path, c.open_n)"""

_SKIPS = "list_has_any(names, ['skip', 'offset'])"
CALL_CONDITIONS = {
    "A01": _SKIPS,
    "A02": f"{_SKIPS} AND NOT list_has_any(names, ['limit', 'take'])",
    "A03": f"{_SKIPS} AND NOT list_has_any(names, ['sort', 'order', 'orderBy'])",
    "A04": "list_contains(names, 'skip') AND arg0_end_n = open_n + 2 AND TRY_CAST(arg0_text AS DOUBLE) > 10000",
    "A05": "list_contains(names, 'skip') AND last_op = '*' AND NOT weaker",
    "A10": r"name IN ('sort', 'order', 'orderBy') AND regexp_full_match(arg0_text, '[\w$.]+') AND regexp_matches(arg0_text, 'req\.query\.(sort|order|sortBy)')",
}
OBJECT_CONDITIONS = {
    "A06": "has_skip",
    "A07": "has_skip AND NOT has_take",
    "A08": "has_skip AND NOT has_order",
    "A09": r"(has_cursor OR has_where) AND (NOT has_order OR (regexp_matches(where_text, 'createdAt\s*:\s*\{\s*(gt|lt)') AND NOT regexp_matches(where_text, '(_id|id)\s*:\s*\{\s*(gt|lt)')))",
}


def _call_hit(rule, cond, source):
    evidence = "array_to_string(names, ' -> ')" if rule == "A01" else "CAST(NULL AS VARCHAR)"
    return (f"SELECT project, file_path, '{rule}' AS rule_id, 0 AS grp, 0 AS detector, start, stop, line_start, line_end, "
            f"text AS code_snippet, CAST(NULL AS VARCHAR) AS strategy_seen, {evidence} AS evidence FROM {source} WHERE {cond}")


DECLARATORS = r"""
decl AS (SELECT project, file_path, content, d AS text, strpos(content, d) - 1 AS start FROM (
           SELECT project, file_path, content, regexp_extract(content, '\b(?:const|let|var)\s+((?:limit|pageSize|first|take)\s*=[^;]*)', 1) AS d FROM code) z WHERE d <> ''),
declarators AS (SELECT project, file_path, text, start, start + length(text) AS stop,
           length(substr(content, 1, start)) - length(replace(substr(content, 1, start), chr(10), '')) + 1 AS line_start,
           length(substr(content, 1, start + length(text))) - length(replace(substr(content, 1, start + length(text)), chr(10), '')) + 1 AS line_end FROM decl)"""

_A11 = r"regexp_matches(text, 'req\.query\.(limit|pageSize|first|take)') AND NOT regexp_matches(text, 'Math\.min\(')"
_PAGE_SIZE = r"regexp_matches(content, 'req\.query\.(limit|pageSize|first|take)')"
CAP = r"regexp_matches(content, 'Math\.min\((?:[^()]*,)?\s*(?:req\.query\.)?(?:limit|pageSize|first|take)\s*[,)]')"

JS_HITS = PROPS + "," + DECLARATORS + ",\ncalls_ops AS (SELECT c.*, o.last_op, o.weaker FROM calls c LEFT JOIN ops o ON o.project = c.project AND o.file_path = c.file_path AND o.open_n = c.open_n),\njs_hits AS (" + " UNION ALL ".join(
    [_call_hit(r, c, "calls_ops") for r, c in CALL_CONDITIONS.items()]
    + [_call_hit(r, c, "qobj") for r, c in OBJECT_CONDITIONS.items()]
    + [_call_hit("A11", _A11, "declarators"),
       _file_hit("A12", f"{_PAGE_SIZE} AND NOT {CAP}", "code", 0, 0, snippet="''", start="2147483647")]) + ")"

# Identifiers of a file: comments and strings removed first, then plain word tests.
GRAPHQL = r"""
bare AS (SELECT project, file_path, content, regexp_replace(content, '(//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|''[^''\\\n]*(?:\\.[^''\\\n]*)*''|`[^`]*`)', ' ', 'g') AS bare
         FROM code WHERE regexp_matches(content, '(first|after|before|last)')),
gq AS (SELECT project, file_path, content, regexp_matches(bare, '\bfirst\b') AS has_first, regexp_matches(bare, '\bafter\b') AS has_after,
         regexp_matches(bare, '\bMath\s*\.\s*min\s*\(') AS has_min FROM bare)"""
GRAPHQL_HITS = GRAPHQL + ",\ng_hits AS (" + " UNION ALL ".join([
    _file_hit("G01", "has_first AND NOT has_min", "gq", 0, 1, strategy="CASE WHEN has_after THEN 'cursor' ELSE 'none' END"),
    _file_hit("G02", "has_after AND NOT regexp_matches(content, 'orderBy|sort')", "gq", 0, 1)]) + ")"

WRAPPERS = r"""
wr AS (SELECT project, file_path, content, length(b) - length(replace(b, chr(10), '')) + 1 AS line FROM (
         SELECT project, file_path, content, substr(content, 1, strpos(content, regexp_extract(content, '\bpaginate\s*\(')) - 1) AS b
         FROM code WHERE regexp_matches(content, '\bpaginate\s*\(')) z),
sites AS (SELECT *, array_to_string(list_slice(string_split(content, chr(10)), greatest(1, line - 1), line + 1), chr(10)) AS context FROM wr)"""
WRAPPER_HITS = WRAPPERS + ",\nw_hits AS (" + " UNION ALL ".join([
    _file_hit("W01", r"NOT regexp_matches(content, 'Math\.min\s*\(') AND NOT regexp_matches(content, '(?i)max(PageSize|Limit|Take)')", "sites", 0, 2, "line", "context"),
    _file_hit("W02", "NOT regexp_matches(content, '(orderBy|sort|ORDER BY)')", "sites", 0, 2, "line", "context")]) + ")"

DIMENSIONS = ("\ntexts AS " + values(rb.RULE_TEXTS, "rule_id, rule_rank, code, severity, strategy, message, root_cause, recommendation", "v")
              + ",\nrules AS " + values(rb.RULES, "code, category, points", "v")
              + ",\nranks AS " + values([(s, i) for i, s in enumerate(rb.SEVERITIES)], "severity, sev", "v"))

ORD = "grp, file_path, detector, start, -stop, rule_rank"
_TEXTED = ("h.project, h.file_path, h.rule_id, h.grp, h.detector, h.start, h.stop, t.rule_rank, h.line_start, h.line_end, h.code_snippet, "
           "coalesce(h.strategy_seen, t.strategy) AS strategy, h.evidence, t.code, t.severity, t.message, t.root_cause, t.recommendation, "
           "k.sev")
RAW = ",".join([SQL_HITS, JS_HITS, GRAPHQL_HITS, WRAPPER_HITS, DIMENSIONS]) + f""",
raw AS MATERIALIZED (SELECT {_TEXTED} FROM (
          SELECT {HIT_COLS} FROM sql_hits UNION ALL SELECT {HIT_COLS} FROM js_hits
          UNION ALL SELECT {HIT_COLS} FROM g_hits UNION ALL SELECT {HIT_COLS} FROM w_hits) h
        JOIN texts t USING (rule_id) JOIN ranks k ON k.severity = t.severity)"""

SIGNALS = """
sig AS (SELECT project, bool_or(coalesce(strategy = 'offset', false) OR code = 'OFFSET_USED') AS has_offset,
          bool_or(coalesce(strategy = 'cursor', false) OR code = 'UNSTABLE_CURSOR') AS has_cursor,
          bool_or(code IN ('OFFSET_USED', 'UNSTABLE_CURSOR', 'NO_ORDER_BY', 'MISSING_LIMIT')) AS paginated,
          count(*) FILTER (WHERE code = 'MISSING_LIMIT') AS unbounded_endpoints,
          bool_or(code = 'UNSTABLE_CURSOR') AS unstable, bool_or(code = 'OFFSET_USED') AS offset_code,
          bool_or(code = 'NO_ORDER_BY') AS no_order, bool_or(code = 'DYNAMIC_SORT_UNSAFE') AS dynamic_sort FROM raw GROUP BY project),
caps AS (SELECT project, count(*) FILTER (WHERE NOT uncapped) AS files_with_cap, count(*) FILTER (WHERE uncapped) AS files_without_cap
         FROM (SELECT project, file_path, bool_or(code = 'NO_PAGE_SIZE_CAP') AS uncapped FROM raw GROUP BY ALL
               HAVING bool_or(code IN ('OFFSET_USED', 'UNSTABLE_CURSOR', 'NO_ORDER_BY', 'MISSING_LIMIT'))) z GROUP BY project),
signals AS (SELECT s.*, coalesce(c.files_with_cap, 0) AS files_with_cap, coalesce(c.files_without_cap, 0) AS files_without_cap
            FROM sig s LEFT JOIN caps c USING (project))"""

PROJECT_CONDITIONS = {
    "M02": "files_with_cap > 0 AND files_without_cap > 0", "M03": "unbounded_endpoints > 1",
    "M04": "unstable OR (offset_code AND no_order)", "M05": "no_order OR dynamic_sort",
}
ENRICHED = RAW + "," + SIGNALS + ",\nproject_hits AS (" + " UNION ALL ".join(
    f"SELECT project, '<project>' AS file_path, '{r}' AS rule_id, 2 AS grp, 0 AS detector, 0 AS start, 0 AS stop, 1 AS line_start, 1 AS line_end, "
    f"CAST(NULL AS VARCHAR) AS code_snippet, CAST(NULL AS VARCHAR) AS strategy_seen, CAST(NULL AS VARCHAR) AS evidence FROM signals WHERE {c}"
    for r, c in PROJECT_CONDITIONS.items()) + f"""),
allf AS (SELECT * FROM raw UNION ALL SELECT {_TEXTED} FROM project_hits h JOIN texts t USING (rule_id) JOIN ranks k ON k.severity = t.severity),
final AS MATERIALIZED (SELECT * FROM allf QUALIFY row_number() OVER (PARTITION BY project, code, file_path, message ORDER BY {ORD}) = 1)"""

# Entry points of the corpus and their chains, by patterns on the text.
_CAND = ("CASE WHEN lower(file_path) LIKE '%/routes/%' THEN 0 WHEN lower(file_path) LIKE '%/controllers/%' THEN 1 "
         "WHEN lower(file_path) LIKE '%/services/%' THEN 2 ELSE 3 END")
UNITS = rf"""
http AS (SELECT c.project, 'http' AS kind, 0 AS kind_rank, c.file_path, c.open_n AS n, c.name AS method, trim(c.arg0_text, '"') AS path,
           c.line_start AS entry_start, c.line_end AS entry_end,
           regexp_extract(c.text, ',\s*([\w$]+)\s*\)$', 1) AS symbol
         FROM calls c WHERE c.name IN {words(rb.HTTP_METHODS)} AND starts_with(c.arg0_text, '"')),
gql AS (SELECT q.project, q.file_path, k.n, q.p1, q.p2, k.t AS field, k.line AS entry_start,
          (SELECT arg_max(b.line, b.n) FROM lv b WHERE b.project = q.project AND b.file_path = q.file_path AND b.n < (
             SELECT min(e.n) FROM lv e WHERE e.project = q.project AND e.file_path = q.file_path AND e.lvl = q.lvl AND e.n > k.n AND (e.t = ',' OR e.n = q.close_n))) AS entry_end
        FROM pairs q JOIN lv k ON k.project = q.project AND k.file_path = q.file_path AND k.lvl = q.lvl AND k.n > q.open_n AND k.n < q.close_n
             AND k.p1 IN ('{{', ',') AND k.x1 IN (':', ',', '}}')
        WHERE q.t = '{{' AND q.p1 = ':' AND q.p2 IN ('Query', 'Mutation')),
disc AS (SELECT project, kind || ':' || file_path || ':' || n AS unit_key, 'http:' || method || ':' || path || ':' || file_path || ':' || entry_start AS unit_id,
           {_CAND} AS cand, file_path AS entry_file, kind_rank, n, kind, upper(method) || ' ' || path AS name, entry_start, entry_end, nullif(symbol, '') AS entry_symbol FROM http
         UNION ALL
         SELECT project, 'graphql:' || file_path || ':' || n, 'graphql:' || p2 || '.' || field || ':' || file_path || ':' || entry_start,
           {_CAND}, file_path, 1, n, 'graphql', p2 || '.' || field, entry_start, entry_end, NULL FROM gql),
imp AS (SELECT project, file_path, regexp_extract(content, 'import \{{ (\w+) \}} from "\.\./([\w/]+)"', 1) AS alias,
          '/' || project || '/src/' || regexp_extract(content, 'import \{{ (\w+) \}} from "\.\./([\w/]+)"', 2) || '.ts' AS to_file FROM code),
fun AS (SELECT project, file_path, symbol, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS BIGINT) AS line FROM (
          SELECT project, file_path, s AS symbol, substr(content, 1, strpos(content, 'function ' || s || '(') - 1) AS b
          FROM (SELECT project, file_path, content, regexp_extract(content, 'function (\w+)\(', 1) AS s FROM code) y WHERE s <> '') z),
edge AS (SELECT i.project, i.file_path AS from_file, d.symbol AS from_symbol, i.to_file, i.alias AS symbol, t.line
         FROM imp i JOIN code c ON c.project = i.project AND c.file_path = i.file_path
         JOIN fun d ON d.project = i.project AND d.file_path = i.file_path
         JOIN fun t ON t.project = i.project AND t.file_path = i.to_file AND t.symbol = i.alias
         WHERE i.alias <> '' AND strpos(c.content, i.alias || '(') > 0),
steps AS (SELECT u.project, u.unit_key, 0 AS depth, i.to_file AS file_path, t.symbol, t.line
          FROM disc u JOIN imp i ON i.project = u.project AND i.file_path = u.entry_file AND i.alias = u.entry_symbol
          JOIN fun t ON t.project = i.project AND t.file_path = i.to_file AND t.symbol = i.alias
          UNION ALL
          SELECT s.project, s.unit_key, s.depth + 1, e.to_file, e.symbol, e.line FROM steps s
          JOIN edge e ON e.project = s.project AND e.from_file = s.file_path AND e.from_symbol = s.symbol WHERE s.depth < 5)"""

_UORD = "cand, entry_file, kind_rank, n"
LAYER = """CASE WHEN lower(file_path) LIKE '%/routes/%' THEN 'route' WHEN lower(file_path) LIKE '%/controllers/%' THEN 'controller'
 WHEN lower(file_path) LIKE '%/services/%' THEN 'service' WHEN lower(file_path) LIKE '%/repositories/%' OR lower(file_path) LIKE '%/repo/%' THEN 'repository'
 WHEN lower(file_path) LIKE '%/models/%' OR lower(file_path) LIKE '%/entities/%' THEN 'model' WHEN lower(file_path) LIKE '%.sql' OR lower(file_path) LIKE '%/sql/%' THEN 'sql'
 WHEN lower(file_path) LIKE '%/graphql/%' OR lower(file_path) LIKE '%/resolvers/%' THEN 'graphql' WHEN lower(file_path) LIKE '%/utils/%' OR lower(file_path) LIKE '%/lib/%' THEN 'utility'
 ELSE 'unknown' END"""


def grouped_ctes(source: str = "final") -> str:
    """grouped: findings with unit, layer and category; ``source`` needs a ``unit_id`` column only when preset."""
    return f"""
owner AS (SELECT f.project, f.file_path, f.rule_id, f.start, f.stop, u.unit_key FROM {source} f
          JOIN disc u ON u.project = f.project AND u.entry_file = f.file_path
          QUALIFY row_number() OVER (PARTITION BY f.project, f.file_path, f.rule_id, f.start, f.stop
            ORDER BY CASE WHEN f.line_start BETWEEN u.entry_start AND u.entry_end THEN 0 ELSE 1 END, {_UORD}) = 1),
chain_owner AS (SELECT s.project, lower(s.file_path) AS lf, u.unit_key FROM steps s JOIN disc u USING (project, unit_key)
          QUALIFY row_number() OVER (PARTITION BY s.project, lower(s.file_path) ORDER BY {_UORD}) = 1),
assigned AS (SELECT f.*, coalesce(o.unit_key, c.unit_key, 'file:' || f.file_path) AS unit_key,
            CASE WHEN o.unit_key IS NOT NULL THEN 'file' WHEN c.unit_key IS NOT NULL THEN 'chain' ELSE 'fallback' END AS assigned_by,
            {LAYER.replace('file_path', 'f.file_path')} AS layer, r.category, r.points
          FROM {source} f
          LEFT JOIN owner o ON o.project = f.project AND o.file_path = f.file_path AND o.rule_id = f.rule_id AND o.start = f.start AND o.stop = f.stop
          LEFT JOIN chain_owner c ON c.project = f.project AND c.lf = lower(f.file_path)
          LEFT JOIN rules r ON r.code = f.code),
grouped AS MATERIALIZED (SELECT * FROM assigned QUALIFY row_number() OVER (PARTITION BY project, unit_key, code, file_path, coalesce(line_start, 1), message ORDER BY {ORD}) = 1),
roots AS (SELECT project, min(root) AS root FROM corpus GROUP BY project),
units AS MATERIALIZED (SELECT project, unit_key, unit_id, 0 AS ugrp, cand, entry_file, kind_rank, n, kind, name, entry_start, entry_end, entry_symbol FROM disc
          UNION ALL
          SELECT g.project, g.unit_key, g.unit_key, 1, 0, g.file_path, 0, 0, 'function',
            CASE WHEN starts_with(g.file_path, r.root || '/') THEN substr(g.file_path, length(r.root) + 2) ELSE g.file_path END, NULL, NULL, NULL
          FROM (SELECT DISTINCT project, unit_key, file_path FROM grouped WHERE assigned_by = 'fallback') g JOIN roots r USING (project))"""


GROUPED = ENRICHED + "," + UNITS + "," + grouped_ctes()
_STATUS = ("CASE WHEN {0} >= 90 THEN 'Production Grade' WHEN {0} >= 75 THEN 'Good' WHEN {0} >= 60 THEN 'Needs Optimization' "
           "WHEN {0} >= 40 THEN 'High Risk' ELSE 'Critical' END")
SCORED = GROUPED + f""",
cp AS (SELECT project, unit_key, code, any_value(points) AS points, any_value(category) AS category,
         arg_min(message, struct_pack(a := grp, b := file_path, c := detector, d := start, e := -stop, f := rule_rank)) AS reason,
         min(struct_pack(a := grp, b := file_path, c := detector, d := start, e := -stop, f := rule_rank)) AS first_ord
       FROM grouped GROUP BY project, unit_key, code),
tot AS (SELECT project, unit_key, CAST(greatest(0, floor(100 - least(sum(points), 85) + 0.5)) AS INT) AS score FROM cp GROUP BY ALL),
cats AS (SELECT project, unit_key, category, CAST(greatest(0, floor(100 - least(100, sum(points)) + 0.5)) AS INT) AS category_score FROM cp GROUP BY ALL),
prof AS (SELECT project, unit_key, count(*) AS issue_count, max(sev) AS max_rank,
           bool_or(severity = 'critical') AS critical, bool_or(severity IN ('critical', 'high')) AS high,
           bool_or(code IN ('MISSING_LIMIT', 'NO_PAGE_SIZE_CAP')) AS unbounded,
           bool_or(coalesce(strategy = 'offset', false) OR code IN ('OFFSET_USED', 'DEEP_OFFSET')) AS offset_unit,
           bool_or(coalesce(strategy = 'cursor', false) OR code IN ('UNSTABLE_CURSOR', 'INFINITE_SCROLL_UNSAFE')) AS cursor_unit,
           bool_or(code = 'NO_ORDER_BY') AS unstable_order, bool_or(code = 'DEEP_OFFSET') AS deep_offset,
           bool_or(code = 'DYNAMIC_SORT_UNSAFE') AS unsafe_sort FROM grouped GROUP BY ALL),
prim AS (SELECT project, unit_key, message AS primary_risk, file_path AS primary_file, line_start AS primary_line FROM grouped
         QUALIFY row_number() OVER (PARTITION BY project, unit_key ORDER BY sev DESC, {ORD}) = 1),
us AS MATERIALIZED (SELECT u.*, coalesce(t.score, 100) AS score, coalesce(p.issue_count, 0) AS issue_count, p.max_rank,
         k.severity AS max_severity, CASE WHEN p.max_rank = 3 THEN 1.5 WHEN p.max_rank = 2 THEN 1.25 ELSE 1.0 END AS weight,
         {', '.join(f'coalesce(p.{x}, false) AS {x}' for x in ('critical', 'high', 'unbounded', 'offset_unit', 'cursor_unit', 'unstable_order', 'deep_offset', 'unsafe_sort'))},
         q.primary_risk, q.primary_file, q.primary_line
       FROM units u LEFT JOIN tot t USING (project, unit_key) LEFT JOIN prof p USING (project, unit_key)
       LEFT JOIN prim q USING (project, unit_key) LEFT JOIN ranks k ON k.sev = p.max_rank),
pm AS (SELECT project, count(*) AS units_scored, count(*) FILTER (WHERE issue_count > 0) AS units_with_issues,
         count(*) FILTER (WHERE critical) AS critical_units, count(*) FILTER (WHERE high) AS high_units,
         count(*) FILTER (WHERE NOT unbounded) AS units_with_bounds, count(*) FILTER (WHERE offset_unit) AS offset_units,
         count(*) FILTER (WHERE cursor_unit) AS cursor_units,
         CAST(floor(count(*) FILTER (WHERE NOT unbounded) / count(*) * 100 + 0.5) AS INT) AS bounds_coverage_percent,
         CAST(floor(count(*) FILTER (WHERE cursor_unit) / count(*) * 100 + 0.5) AS INT) AS keyset_usage_percent,
         CAST(floor(count(*) FILTER (WHERE offset_unit) / count(*) * 100 + 0.5) AS INT) AS offset_usage_percent,
         CAST(floor(count(*) FILTER (WHERE NOT unstable_order) / count(*) * 100 + 0.5) AS INT) AS stable_order_coverage_percent,
         count(*) FILTER (WHERE deep_offset) AS deep_offset_units, count(*) FILTER (WHERE unbounded) AS unbounded_units,
         count(*) FILTER (WHERE unsafe_sort) AS unsafe_sort_units FROM us GROUP BY project),
ps AS (SELECT project, CAST(floor(sum(weight * score) / sum(weight) + 0.5) AS INT) AS score FROM us GROUP BY project)"""


def first_seen(column: str, source: str = "grouped", keys: str = "project", where: str = "true") -> str:
    """Distinct values of a column with their rank by first appearance."""
    return (f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY o) AS rank, txt FROM (SELECT {keys}, {column} AS txt, "
            f"min(struct_pack(a := grp, b := file_path, c := detector, d := start, e := -stop, f := rule_rank)) AS o FROM {source} "
            f"WHERE {column} IS NOT NULL AND {where} GROUP BY {keys}, {column}) z")


def status(expr: str) -> str:
    return _STATUS.format(expr)


def q(ctes: str, select: str, corpus: str | None = None) -> str:
    files = FILES if corpus is None else files_ctes(corpus)
    return f"WITH RECURSIVE {files}{',' + ctes if ctes else ''}\n{select}"
