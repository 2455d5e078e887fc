"""Fixed values of the audit: rule texts, points, thresholds, word lists, file globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values ---------------------------------------------------------------------------
DEEP_OFFSET_THRESHOLD = 10_000
MAX_PAGE_SIZE = 50
UNIT_DEDUCTION_CAP = 85
SCHEMA_VERSION = 2
CHAIN_MAX_DEPTH = 6
PROJECT_PATH = "<project>"

IGNORED_GLOBS = (
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/.next/**",
    "**/coverage/**",
    "**/tests/**",
    "**/*.test.*",
    "**/*.spec.*",
)
USER_IGNORED_GLOBS = ("node_modules", "dist", ".git")
BACKEND_HINTS = ("backend", "api", "server", "apps/api", "services/api")
MAX_ALLOWED_SEVERITY = "high"

OFFSET_CALLS = ("skip", "offset")
LIMIT_CALLS = ("limit", "take")
ORDER_CALLS = ("sort", "order", "orderBy")
QUERY_OBJECT_CALLS = ("findMany", "findAll")
PAGE_SIZE_NAMES = ("limit", "pageSize", "first", "take")
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "options", "head")
HTTP_DECORATORS = ("Get", "Post", "Put", "Patch", "Delete", "Options", "Head")
GRAPHQL_TYPES = ("Query", "Mutation")

SEVERITIES = ("low", "medium", "high", "critical")

# code, score category, points
RULES = (
    ("MISSING_LIMIT", "Bounds", 30),
    ("NO_PAGE_SIZE_CAP", "Bounds", 15),
    ("MULTIPLE_UNBOUNDED_ENDPOINTS", "Bounds", 20),
    ("NO_ORDER_BY", "Ordering", 15),
    ("ORDER_BY_WITHOUT_INDEX_HINT", "Ordering", 8),
    ("UNSTABLE_CURSOR", "CursorStability", 10),
    ("INFINITE_SCROLL_UNSAFE", "CursorStability", 12),
    ("OFFSET_USED", "DepthCost", 10),
    ("DEEP_OFFSET", "DepthCost", 20),
    ("MULTIPLICATION_SKIP", "DepthCost", 10),
    ("POTENTIAL_FULL_COLLECTION_SCAN", "DepthCost", 12),
    ("CONCURRENT_WRITES_RISK", "Consistency", 12),
    ("INCONSISTENT_PAGE_SIZE_CONTROL", "Consistency", 8),
    ("DYNAMIC_SORT_UNSAFE", "InputSafety", 8),
)

# rule id, rank inside its detector, code, severity, strategy, message, root cause, recommendation
RULE_TEXTS = (
    ("A01", 1, "OFFSET_USED", "high", "offset",
     "Offset pagination usage detected.",
     "Offset/skip scales linearly with large page depth.",
     "Prefer keyset pagination for large datasets."),
    ("A02", 2, "MISSING_LIMIT", "critical", "offset",
     "Pagination query appears to have no limit/take cap.",
     "Unbounded query may return huge result set.",
     "Add hard max page size and default limit."),
    ("A03", 3, "NO_ORDER_BY", "high", "offset",
     "Offset pagination detected without explicit order.",
     "Unstable ordering causes page drift and duplicates.",
     "Add deterministic ORDER BY or sort()."),
    ("A04", 4, "DEEP_OFFSET", "high", "offset",
     "Deep OFFSET usage detected (skip > 10000).",
     "Large offset requires scanning/discarding many rows.",
     "Switch to cursor/keyset pagination."),
    ("A05", 5, "MULTIPLICATION_SKIP", "high", "offset",
     "Multiplication-based skip detected (e.g., page * limit).",
     "Page-depth grows scan cost rapidly.",
     "Use keyset cursor and hard cap limit."),
    ("A06", 6, "OFFSET_USED", "high", "offset",
     "Offset pagination object pattern detected.",
     None,
     "Move heavy endpoints to keyset pagination."),
    ("A07", 7, "MISSING_LIMIT", "critical", "offset",
     "skip/offset used without take/limit.",
     None,
     "Always pair skip/offset with strict limit/take."),
    ("A08", 8, "NO_ORDER_BY", "high", "offset",
     "Offset query object missing orderBy/order.",
     None,
     "Add stable order and index support."),
    ("A09", 9, "UNSTABLE_CURSOR", "high", "cursor",
     "Cursor pattern appears unstable (missing unique tie-breaker/order).",
     "Non-unique cursor fields can duplicate/skip records under writes.",
     "Use cursor on (createdAt, id/_id) with matching composite order."),
    ("A10", 10, "DYNAMIC_SORT_UNSAFE", "medium", None,
     "Dynamic sorting from request input detected.",
     "Unbounded dynamic sorting may bypass indexes and be unsafe.",
     "Whitelist sortable columns and map to indexed fields."),
    ("A11", 11, "NO_PAGE_SIZE_CAP", "high", None,
     "Page size appears sourced from query params without explicit max cap.",
     None,
     "Enforce Math.min(limit, 50) style upper bound."),
    ("A12", 12, "NO_PAGE_SIZE_CAP", "high", None,
     "No max page size enforcement pattern detected.",
     None,
     "Apply strict upper limit (e.g. 50)."),
    ("G01", 1, "NO_PAGE_SIZE_CAP", "high", None,
     "GraphQL pagination uses 'first' without max cap enforcement.",
     None,
     "Clamp first: Math.min(first, 50)."),
    ("G02", 2, "INFINITE_SCROLL_UNSAFE", "high", "cursor",
     "Infinite-scroll style cursor ('after') without stable ordering.",
     "Cursor progression can become inconsistent under writes.",
     "Use deterministic order + unique tie-breaker key."),
    ("W01", 1, "NO_PAGE_SIZE_CAP", "high", None,
     "Shared paginate() utility found without visible max page size cap.",
     None,
     "Add hard max cap in the paginate utility."),
    ("W02", 2, "NO_ORDER_BY", "medium", None,
     "Shared paginate() utility does not enforce stable order.",
     None,
     "Always enforce deterministic order in utility layer."),
    ("Q01", 1, "OFFSET_USED", "medium", "offset",
     "Offset pagination detected in raw SQL.",
     None,
     "Prefer keyset pagination for deep pages."),
    ("Q02", 2, "OFFSET_USED", "high", "offset",
     "OFFSET/FETCH pagination pattern detected.",
     None,
     "Consider keyset pagination for large result sets."),
    ("Q03", 3, "MISSING_LIMIT", "critical", None,
     "SELECT query appears without LIMIT.",
     "Unbounded SQL result set risk.",
     "Add LIMIT with strict maximum control."),
    ("Q04", 4, "NO_ORDER_BY", "high", "offset",
     "OFFSET used without ORDER BY in SQL.",
     None,
     "Use stable ORDER BY to avoid page drift."),
    ("Q05", 5, "DEEP_OFFSET", "high", "offset",
     "Deep OFFSET usage detected (offset > 10000).",
     None,
     "Move to cursor/keyset pagination."),
    ("Q06", 6, "POTENTIAL_FULL_COLLECTION_SCAN", "high", None,
     "Potential full collection scan in raw SQL.",
     "Query can read full table without bounds.",
     "Add indexed filters plus LIMIT."),
    ("Q07", 7, "POTENTIAL_FULL_COLLECTION_SCAN", "medium", None,
     "Window-function pagination without LIMIT detected.",
     "Windowed result may still scan large row sets without explicit LIMIT.",
     "Combine window pagination with LIMIT and indexed partition/order keys."),
    ("M02", 1, "INCONSISTENT_PAGE_SIZE_CONTROL", "medium", None,
     "Inconsistent page size control detected across pagination endpoints.",
     "Some endpoints enforce caps while others don't.",
     "Centralize pagination validation in shared middleware/utility."),
    ("M03", 2, "MULTIPLE_UNBOUNDED_ENDPOINTS", "critical", None,
     "Multiple unbounded pagination endpoints detected.",
     "Repeated missing-limit patterns can cause systemic load risk.",
     "Apply global max page-size guard and endpoint-level limits."),
    ("M04", 3, "CONCURRENT_WRITES_RISK", "high", None,
     "Pagination consistency risk under concurrent writes detected.",
     "Unstable ordering/cursor can shift boundaries while data mutates.",
     "Use stable, unique ordering and keyset pagination."),
    ("M05", 4, "ORDER_BY_WITHOUT_INDEX_HINT", "medium", None,
     "ORDER BY may not map to indexed columns (best-effort heuristic).",
     None,
     "Add/verify composite index for ordered cursor fields (e.g. createdAt, _id)."),
)

# Appended, in this order, to a project's recommendations when one of the codes is present.
GENERAL_ADVICE = (
    (("OFFSET_USED", "DEEP_OFFSET"),
     "Switch to keyset pagination where endpoints are high-volume."),
    (("UNSTABLE_CURSOR", "NO_ORDER_BY"),
     "Add composite index for stable cursor sort keys (e.g. createdAt, _id)."),
    (("NO_PAGE_SIZE_CAP", "MISSING_LIMIT"),
     "Enforce max page size = 50 at validation layer."),
)

NEXT_ACTION_UNBOUNDED = (
    "Add hard cap + default limit (e.g. 50) in shared validation for unbounded endpoints.")
NEXT_ACTION_DEEP_OFFSET = (
    "Move top endpoints from deep OFFSET to keyset pagination using stable unique keys.")
NEXT_ACTION_ORDER = (
    "Add deterministic ORDER BY with a tie-breaker key (e.g. primary key) on all paginated queries.")
NEXT_ACTION_SORT = (
    "Whitelist allowed sort keys and map them to indexed columns before building ORDER BY clauses.")

STATUS_BANDS = (
    (90, "Production Grade"),
    (75, "Good"),
    (60, "Needs Optimization"),
    (40, "High Risk"),
)
LOWEST_STATUS = "Critical"

# Path fragments by layer; the first match wins.
LAYER_FRAGMENTS = (
    ("route", ("/routes/",)),
    ("controller", ("/controllers/",)),
    ("service", ("/services/",)),
    ("repository", ("/repositories/", "/repo/")),
    ("model", ("/models/", "/entities/")),
    ("sql", ("/sql/",)),
    ("graphql", ("/graphql/", "/resolvers/")),
    ("utility", ("/utils/", "/lib/")),
)
ROLE_FOLDERS = ("controllers", "routes", "services", "models", "utils")
ORM_FRAGMENTS = (
    ("Prisma", ("prisma",)),
    ("Mongoose", ("mongoose", "model")),
    ("Sequelize", ("sequelize",)),
)
# --- End of fixed values --------------------------------------------------------------------


def _values(spark: SparkSession, rows, names: str) -> DataFrame:
    """A local relation: its size is known to the optimizer, so joins to it are broadcast."""
    def cell(v):
        if v is None:
            return "CAST(NULL AS STRING)"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def rules_table(spark: SparkSession) -> DataFrame:
    """Score dimension ``(code, category, points)``; callers may pass their own to ``audit``."""
    return _values(spark, RULES, "code, category, points")


def rule_texts_table(spark: SparkSession) -> DataFrame:
    """Texts of the 27 built-in rules, one row per rule id."""
    return _values(
        spark, RULE_TEXTS,
        "rule_id, rule_rank, code, severity, strategy, message, root_cause, recommendation")
