"""A code corpus derived from the ``events`` table: one file per event, sixteen templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The same text runs in Spark SQL and in other ANSI engines.
CORPUS_SQL = """
SELECT concat('p', CAST(g % 25 AS STRING)) AS project,
       concat('/p', CAST(g % 25 AS STRING)) AS root,
       concat('/p', CAST(g % 25 AS STRING), '/src/',
         CASE k WHEN 0 THEN 'sql/a' WHEN 1 THEN 'sql/b' WHEN 2 THEN 'sql/c' WHEN 3 THEN 'sql/d' WHEN 4 THEN 'sql/e'
                WHEN 5 THEN 'repositories/r' WHEN 6 THEN 'repositories/q' WHEN 7 THEN 'services/s' WHEN 8 THEN 'services/t'
                WHEN 9 THEN 'services/u' WHEN 10 THEN 'routes/x' WHEN 11 THEN 'controllers/c' WHEN 12 THEN 'resolvers/f'
                WHEN 13 THEN 'utils/w' WHEN 14 THEN 'utils/y' ELSE 'tests/z' END,
         CAST(g AS STRING), CASE WHEN k <= 4 THEN '.sql' ELSE '.ts' END) AS file_path,
       CASE k
         WHEN 0 THEN concat('SELECT * FROM t', CAST(g AS STRING), ' OFFSET ', CAST(v AS STRING), ';')
         WHEN 1 THEN concat('SELECT id FROM t', CAST(g AS STRING), ' ORDER BY id LIMIT 50;')
         WHEN 2 THEN concat('SELECT id FROM t ORDER BY id', chr(10), 'OFFSET ', CAST(v AS STRING), ' ROWS FETCH NEXT 20 ROWS ONLY;')
         WHEN 3 THEN 'SELECT id, ROW_NUMBER() OVER (ORDER BY id) AS rn FROM t;'
         WHEN 4 THEN concat('select * from t limit 10 offset ', CAST(v AS STRING), ';')
         WHEN 5 THEN concat('export async function repo', CAST(g AS STRING), '(db, page, limit) {', chr(10), '  return db.user.findMany({ skip: page * limit });', chr(10), '}', chr(10))
         WHEN 6 THEN concat('export const q = (db, c) =>', chr(10), '  db.user.findMany({ where: { createdAt: { gt: c } }, orderBy: { createdAt: "asc" }, take: 20 });', chr(10))
         WHEN 7 THEN concat('// old: db.find().skip(1)', chr(10), 'export function s(db, limit) {', chr(10), '  const n = Math.min(limit, 50);', chr(10), '  return db.user.findMany({ take: n, orderBy: { id: "asc" } });', chr(10), '}', chr(10))
         WHEN 8 THEN concat('export const t = (M) =>', chr(10), '  M.find({}).skip(', CAST(v AS STRING), ').limit(20);', chr(10))
         WHEN 9 THEN concat('export const u = (M, req, page, limit) =>', chr(10), '  M.find({}).sort(req.query.sort).skip((page - 1) * limit).limit(limit);', chr(10))
         WHEN 10 THEN concat('import { h', CAST(g AS STRING), ' } from "../controllers/c', CAST(g AS STRING), '";', chr(10), 'export function reg(app) {', chr(10), '  app.get("/x', CAST(g AS STRING), '", h', CAST(g AS STRING), ');', chr(10), '}', chr(10))
         WHEN 11 THEN concat('import { repo', CAST(g AS STRING), ' } from "../repositories/r', CAST(g AS STRING), '";', chr(10), 'export async function h', CAST(g AS STRING), '(req, res) {', chr(10), '  const limit = parseInt(String(req.query.limit), 10);', chr(10), '  res.json(await repo', CAST(g AS STRING), '(db, 1, limit));', chr(10), '}', chr(10))
         WHEN 12 THEN concat('export const r = {', chr(10), '  Query: {', chr(10), '    feed: async (_, args) => {', chr(10), '      return [args.first, args.after];', chr(10), '    }', chr(10), '  }', chr(10), '};', chr(10))
         WHEN 13 THEN concat('export function list(q) {', chr(10), '  return paginate(q);', chr(10), '}', chr(10))
         WHEN 14 THEN concat('export function list(q, n) {', chr(10), '  return paginate(q.orderBy("id"), Math.min(n, 50));', chr(10), '}', chr(10))
         ELSE concat('it("x", () => M.find({}).skip(5));', chr(10)) END AS content
FROM (SELECT event_id % 16 AS k, CAST(floor(event_id / 16) AS BIGINT) AS g, (event_id * 37) % 20000 AS v FROM {events}) e
"""

# Prose tables seen as source files: every text once as an SQL file and once as a code file.
PROSE_SQL = """
WITH d AS (
  SELECT 'documents' AS source, concat('/prose/', lang, '/', CAST(doc_id AS STRING)) AS stem, text FROM {documents}
  UNION ALL SELECT 'pages', concat('/prose/html/', CAST(page_id AS STRING)), html FROM {pages}
  UNION ALL SELECT 'conversations', concat('/prose/', role, '/', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), text FROM {conversations}
)
SELECT source AS project, '/' AS root, concat(stem, '.sql') AS file_path, text AS content FROM d
UNION ALL SELECT source, '/', concat(stem, '.ts'), text FROM d
"""


def _over_spread_tables(spark: SparkSession, sf_dir: str, text: str, **keys: list[str]) -> DataFrame:
    """Like ``_over_tables`` for a ``text`` that reads its tables more than once: they are spread by ``keys`` before it, so each is exchanged once."""
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(spark.sparkContext.defaultParallelism, *key) for table, key in keys.items()})


def _over_tables(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Run ``text`` over parquet tables; its ``{table}`` marks become the files themselves."""
    for table in tables:
        text = text.replace("{%s}" % table, f"parquet.`{sf_dir}/{table}.parquet`")
    # The given tables are single files; as a table of sources they are spread like one.
    return spark.sql(text).repartition(spark.sparkContext.defaultParallelism, "project", "file_path")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_tables(spark, sf_dir, CORPUS_SQL, "events")


def prose_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_spread_tables(spark, sf_dir, PROSE_SQL, documents=["doc_id"], pages=["page_id"], conversations=["conv_id", "turn"])


# Folder layouts over the ``documents`` table: forty projects with backend folders, roles, ORM
# hints and ignored paths; the whole document is the file's text.
TREE_SQL = """
SELECT concat('d', CAST(p AS STRING)) AS project, concat('/ws/d', CAST(p AS STRING)) AS root,
       concat('/ws/d', CAST(p AS STRING), '/',
         CASE WHEN doc_id % 7 = 0 THEN ''
              ELSE CASE p % 6 WHEN 0 THEN 'backend/' WHEN 1 THEN 'api/' WHEN 2 THEN 'server/' WHEN 3 THEN 'apps/api/'
                              WHEN 4 THEN 'services/api/' ELSE '' END END,
         CASE r % 12 WHEN 0 THEN 'src/controllers/' WHEN 1 THEN 'src/routes/' WHEN 2 THEN 'src/services/' WHEN 3 THEN 'src/models/'
                     WHEN 4 THEN 'src/Utils/' WHEN 5 THEN 'node_modules/lib/' WHEN 6 THEN 'src/prisma/' WHEN 7 THEN 'dist/'
                     WHEN 8 THEN '.next/x/' WHEN 9 THEN 'src/tests/' WHEN 10 THEN 'src/sequelize/' ELSE 'src/' END,
         'f', CAST(doc_id AS STRING),
         CASE doc_id % 5 WHEN 0 THEN '.test.js' WHEN 1 THEN '.sql' WHEN 2 THEN '.tsx' WHEN 3 THEN '.txt' ELSE '.ts' END) AS file_path,
       text AS content
FROM (SELECT doc_id, doc_id % 40 AS p, CAST(floor(doc_id / 40) AS BIGINT) AS r, text FROM {documents}) d
"""

# Code shapes the first corpus lacks, one file per customer.
EDGE_TEMPLATES = (
    '@Controller("cats")\nexport class Cats {\n  @Get("list")\n  async list(q) {\n    return this.m.find().skip(q.n).limit(5);\n  }\n\n'
    '  @Post()\n  create(b) { return b; }\n}\n',
    'export class CatsResolver {\n  @UseGuards(G)\n  @Query("cats")\n  all() { return []; }\n  @Mutation()\n  add(x) {\n    return x;\n  }\n}\n',
    'export const f = (M, offset, limit) => M.findAll({ offset, limit, order: [["id"]] });\n',
    'export const f = (M) =>\n  M.find()["skip"](20000).limit(5);\n',
    'export const f = (db) => db?.user.find().skip(5);\n',
    'export const f = (a) => new Q(a).skip(3);\n',
    'export const f = (a, b, x) => (a + b).skip(2).sort(x);\n',
    'export const f = (M) => M.find().skip(0).limit(20000);\n',
    'export const f = (M) => M.find().offset(20000);\n',
    'export const f = (M, page, size) => M.find().skip(page * size + 1).limit(9).order("id");\n',
    'export const f = (M, page, size) => M.find().skip((page - 1) * (size || 10)).limit(9);\n',
    '// M.find().skip(1)\n/* M.find()\n .skip(2) */\nconst s = "M.find().skip(3)", r = /M.find\\(\\).skip\\(4"/g, t = `M.find().skip(5)`;\n',
    'export function h(req) {\n  const limit = Math.min(req.query.limit, 50);\n  return limit;\n}\n',
    'export function h(req) {\n  const limit = Math.min(Number(req.query.limit), 50);\n  return limit;\n}\n',
    'export function h(req) {\n  const { limit } = req.query;\n  return limit;\n}\n',
    'export function h(req, run) {\n  let a = 1, pageSize = +req.query.pageSize\n  run(a)\n}\n',
    'export function h(M, req, sortBy) {\n  M.find().sort(sortBy).skip(2).limit(3);\n  M.find().order(req.query.order[0]);\n}\n',
    'export const f = (db, c) => db.p.findMany({ cursor: { id: c }, orderBy: { id: "asc" }, take: 5 });\n',
    'export const f = (db) =>\n  db.p.findMany({ where: { a: 1 } });\n',
    'export const f = (db, c, d) => db.p.findMany({ where: { createdAt: { lt: c }, _id: { lt: d } }, orderBy: [{ createdAt: "desc" }, { _id: "desc" }] });\n',
    'export const f = (db, args) => db.p.findMany(args).skip(1);\n',
    'export const f = (z, w) => z.m(w.n().o()).skip(4).data.take(5);\n',
    'const resolvers = {\n  Mutation: { add: addUser, del },\n  Query: {\n    list: async () => 1,\n    async m() { return 2; },\n    ...rest\n  }\n};\n',
    'export function reg(router, map, app, path, ctrl, h) {\n  router["post"]("/a", ctrl.save);\n  map.get("k");\n  app.get(path, h);\n'
    "  app.delete('/b', (req, res) => {\n    res.end();\n  });\n  app.get(\"/c\", h);\n}\n",
    'export const broken = (a => {\n  M.find().skip(1);\n',
)


def _text_literal(text: str) -> str:
    """A text as an expression without escapes, the same in every SQL dialect."""
    special = {"\n": "chr(10)", "\\": "chr(92)", "'": "chr(39)"}
    parts, run = [], ""
    for ch in text:
        if ch in special:
            parts += [f"'{run}'"] if run else []
            parts.append(special[ch])
            run = ""
        else:
            run += ch
    parts += [f"'{run}'"] if run else []
    return f"concat({', '.join(parts)})"


EDGE_SQL = f"""
SELECT concat('e', CAST(c_nationkey AS STRING)) AS project, concat('/e', CAST(c_nationkey AS STRING)) AS root,
       concat('/e', CAST(c_nationkey AS STRING), '/src/m', CAST(c_custkey % {len(EDGE_TEMPLATES)} AS STRING), '/f', CAST(c_custkey AS STRING), '.ts') AS file_path,
       CASE c_custkey % {len(EDGE_TEMPLATES)} {' '.join(f"WHEN {i} THEN {_text_literal(t)}" for i, t in enumerate(EDGE_TEMPLATES))} END AS content
FROM {{customer}}
"""


def tree_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_tables(spark, sf_dir, TREE_SQL, "documents")


def edge_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_tables(spark, sf_dir, EDGE_SQL, "customer")


# Small projects for each supplier: files whose text needs modes to be read, and modules that pass names on. ``#`` is the supplier's key.
MODE_FILES = (
    ("modes/template.ts", "export const a# = async (M) => `${await M.find().skip(5)} and ${`in ${M.list({ q: `}` }).offset(#)} it`}`;\nrun.done();\n"),
    ("modes/markup.tsx", 'export const V# = (M) => <p title="(">step (a don\'t {M.find().skip(5)} can\'t<br /> <b>x</b></p>;\nN.find().skip(#);\n'),
    ("modes/types.ts", "M.find<A<B<C<D<E<F>>>>>>({}).skip(5);\nM.list<(a: X) => Y[]>({}).skip(#);\nM.pick<T extends U ? V<T> : { a: W<T>; b?: X }>(1);\nif (a.b<c && d.e>(f)) g.h();\n"),
    ("modes/open.ts", "M.find().skip(1);\nfunction f#() {\n  if (x) {\n    A.find().skip(2);\n}\nfunction g#() { return N.find().skip(3); }\n"),
    ("modes/loose.ts", "B.find(({a: 1});\nN.find().skip(#);\nconst c = [1, 2;\nP.find().limit(4);\n"),
    ("modes/stray.ts", "M.find().skip(1)\n}}\nN.find().skip(2)\n"),
    ("modes/groups.ts", "(M.find({a: #})).skip(5);\nconst a# = ((N.list()).sort(b)\n).skip(5);\n(await P.find()).skip(6);\n(Q?.find()).skip(7);\n"),
)
MODULE_FILES = (
    ("web/a.ts", 'import { list, save as store } from "../barrel";\nimport def from "../default";\nconst { old, kept: k } = require("../common.js");\nconst whole = require("../whole");\n'
                 'import { far } from "../far/index.js";\nimport { lost } from "../cycle/a";\nimport { aliased } from "@/store";\n// import { gone } from "../impl/store";\n'
                 "r.get('/list#', list);\nr.post('/save', store);\nr.put('/def', def);\nr.get('/old', old);\nr.get('/k', k);\nr.get('/whole', whole);\nr.get('/far', far);\n"
                 "r.get('/lost', lost);\nr.get('/aliased', aliased);\nr.get('/gone', gone);\n"),
    ("shadow/a.ts", 'import { list, put } from "../impl/other";\nexport function param(list) { list(1); }\nexport function inner(a) { const list = () => a; list(); { let put = a; } return put(a); }\n'
                    "export const arrow = ({ list }, [put]) => list(put(own()));\nfunction own() {}\nr.get('/param', param);\nr.get('/inner', inner);\nr.get('/arrow', arrow);\n"),
    ("impl/other.ts", "export function list() {}\nexport function put() {}\n"),
    ("barrel.ts", 'export { list, put as save } from "./impl/store";\nexport { default } from "./default";\n'),
    ("impl/store.ts", "export function list(a) { return inner(a); }\nfunction inner(a) { return a; }\nconst write = (a) => a;\nexport { write as put };\nexport const aliased = 1;\n"),
    ("default.ts", "const handler = (a) => a;\nexport default handler;\n"),
    ("common.js", "function old(a) { return a; }\nfunction hidden(a) { return a; }\nmodule.exports = { old, kept: hidden };\n"),
    ("whole.js", "function main(a) { return a; }\nmodule.exports = main;\n"),
    ("far/index.ts", 'export * from "./b";\nexport * from "./other";\n'),
    ("far/b.ts", 'export * from "./c";\nexport * from ".";\n'),
    ("far/c.ts", 'import { deep } from "./d";\nexport { deep as far };\n'),
    ("far/d.ts", "export const deep = (a) => a;\n"),
    ("far/other.ts", "export const far2 = 1;\n"),
    ("cycle/a.ts", 'export { lost } from "./b";\n'),
    ("cycle/b.ts", 'export { lost } from "./a";\n'),
    ("tsconfig.json", '{ // one alias\n "compilerOptions": { "paths": { "@/*": ["impl/*"] } } }'),
)


def module_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of these files for each row of ``supplier``."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    key = F.col("s_suppkey").cast("string")
    each = suppliers.select("s_suppkey", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in MODE_FILES + MODULE_FILES])).alias("f"))
    project = F.concat(F.lit("m"), (F.col("s_suppkey") % 10).cast("string"))
    root = F.concat(F.lit("/"), project)
    files = each.select(project.alias("project"), root.alias("root"), F.concat_ws("/", root, F.concat(F.lit("k"), key), "f.path").alias("file_path"), F.replace("f.text", F.lit("#"), key).alias("content"))
    return files.repartition(spark.sparkContext.defaultParallelism, "project", "file_path")
