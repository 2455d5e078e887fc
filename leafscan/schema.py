"""Table schemas of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SOURCE_FILES = "project STRING, root STRING, file_path STRING, content STRING"

# Order of findings inside a project: detector group, file, detector, position, rule.
FINDING_ORD = (
    "STRUCT<grp: INT, file_path: STRING, detector: INT, start: INT, neg_end: INT, rule_rank: INT>"
)

FINDINGS = (
    f"project STRING, finding_ord {FINDING_ORD}, rule_id STRING, code STRING, severity STRING, "
    "message STRING, file_path STRING, line_start INT, line_end INT, code_snippet STRING, "
    "strategy STRING, root_cause STRING, recommendation STRING, evidence STRING, "
    "confidence DOUBLE, layer STRING, unit_id STRING, category STRING"
)

CALL_STEP = "STRUCT<file_path: STRING, symbol: STRING, line: INT>"

UNITS = (
    "project STRING, unit_key STRING, unit_id STRING, "
    "unit_ord STRUCT<grp: INT, candidate_rank: INT, file_path: STRING, kind_rank: INT, start: INT>, "
    "kind STRING, name STRING, entry_file STRING, entry_start INT, entry_end INT, "
    f"entry_symbol STRING, meta MAP<STRING, STRING>, call_chain ARRAY<{CALL_STEP}>"
)


def conform(df: DataFrame, ddl: str, *more: str) -> DataFrame:
    """Select the columns of ``ddl`` in order, adding the missing ones as typed nulls, and ``more`` columns as they are."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(ddl)
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in wanted.fields
    ], *more)
