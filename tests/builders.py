"""Small tables for tests."""

from pyspark.sql import functions as F

from leafscan.schema import FINDINGS, SOURCE_FILES, UNITS, conform

# --- Fixed values: three small projects with known results -------------------------------------
FIXTURES = {
    "backend-risk": {
        "src/controllers/userController.ts": 'import { Request, Response } from "express";\nimport { User } from "../models/User";\n\nexport async function listUsers(req: Request, res: Response) {\n  const page = parseInt(String(req.query.page ?? "1"), 10);\n  const limit = parseInt(String(req.query.limit ?? "20"), 10);\n\n  const users = await User.find({})\n    .skip(page * limit)\n    .limit(limit);\n\n  res.json(users);\n}\n',
        "src/services/feedResolver.ts": 'export const feedResolver = {\n  Query: {\n    feed: async (_: unknown, args: { first?: number; after?: string }) => {\n      const first = args.first ?? 20;\n      const after = args.after;\n\n      if (!after) {\n        return [];\n      }\n\n      return [{ first, after }];\n    }\n  }\n};\n',
        "src/services/users.sql": "SELECT * FROM users OFFSET 12000;\n",
    },
    "backend-layered": {
        "src/routes/usersRoutes.ts": 'import { getUsers } from "../controllers/usersController";\n\nexport function registerRoutes(app: any) {\n  app.get("/users", getUsers);\n}\n',
        "src/controllers/usersController.ts": 'import { usersService } from "../services/usersService";\n\nexport async function getUsers(req: any, res: any) {\n  const page = parseInt(String(req.query.page ?? "0"), 10);\n  const limit = parseInt(String(req.query.limit ?? "50"), 10);\n  const data = await usersService.listUsers({ page, limit });\n  res.json({ data });\n}\n',
        "src/services/usersService.ts": 'import { listUsers } from "../repositories/usersRepo";\n\nexport const usersService = {\n  async listUsers(input: { page: number; limit: number }) {\n    return listUsers(input);\n  }\n};\n',
        "src/repositories/usersRepo.ts": "export async function listUsers(input: { page: number; limit: number }) {\n  const { page, limit } = input;\n  const db: any = (globalThis as any).db;\n  return db.user.findMany({\n    skip: page * limit,\n    take: limit\n  });\n}\n",
    },
    "backend-safe": {
        "src/services/userService.ts": 'type CursorInput = {\n  cursor?: string;\n  limit?: number;\n};\n\nexport async function listUsersKeyset(input: CursorInput) {\n  const limit = Math.min(input.limit ?? 20, 50);\n  const cursor = input.cursor;\n\n  // Representative keyset-like query shape in code\n  return {\n    where: {\n      createdAt: { gt: cursor },\n      _id: { gt: cursor }\n    },\n    orderBy: [{ createdAt: "asc" }, { _id: "asc" }],\n    take: limit\n  };\n}\n',
    },
}
# --- End of fixed values ---------------------------------------------------------------------


def source_files(spark, tree):
    """``{project: {path: text}}`` as source files under ``/<project>``."""
    rows = [(p, f"/{p}", f"/{p}/{path}", text) for p, files in tree.items() for path, text in files.items()]
    return spark.createDataFrame(rows, SOURCE_FILES)


def findings(spark, rows):
    """Dicts as findings; the order of the list is the order of the findings."""
    full = []
    for i, row in enumerate(rows):
        full.append((
            row.get("project", "p"), i, row["code"], row.get("severity", "high"), row.get("message", row["code"]),
            row.get("file", "/p/a.ts"), row.get("line"), row.get("strategy"), row.get("cause"), row.get("advice"),
            row.get("confidence"), row.get("unit_id"), row.get("category")))
    df = spark.createDataFrame(
        full, "project STRING, i INT, code STRING, severity STRING, message STRING, file_path STRING, line_start INT, "
        "strategy STRING, root_cause STRING, recommendation STRING, confidence DOUBLE, unit_id STRING, category STRING")
    zero = F.lit(0)
    ord_ = F.struct(zero.alias("grp"), F.lit("").alias("file_path"), zero.alias("detector"), F.col("i").alias("start"),
                    zero.alias("neg_end"), zero.alias("rule_rank"))
    return conform(df.withColumn("finding_ord", ord_), FINDINGS)


def units(spark, rows):
    """Dicts as discovered units, in order."""
    full = [(
        row.get("project", "p"), row["key"], row.get("id", row["key"]), i, row.get("name", row["key"]), row.get("file"),
        row.get("start"), row.get("end"), [(f, "s", 1) for f in row.get("chain", [])]) for i, row in enumerate(rows)]
    df = spark.createDataFrame(
        full, "project STRING, unit_key STRING, unit_id STRING, i INT, name STRING, entry_file STRING, entry_start INT, "
        "entry_end INT, call_chain ARRAY<STRUCT<file_path: STRING, symbol: STRING, line: INT>>")
    zero = F.lit(0)
    ord_ = F.struct(zero.alias("grp"), zero.alias("candidate_rank"), F.lit("").alias("file_path"), zero.alias("kind_rank"), F.col("i").alias("start"))
    return conform(df.withColumns({"unit_ord": ord_, "kind": F.lit("http")}), UNITS)
