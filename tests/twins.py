"""Run registered queries and their DuckDB twins over the same tables and compare the rows.

``python tests/twins.py [sf_dir] [name prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) else round(value, 9)
    return int(value) if isinstance(value, int) else value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, db, sf_dir: str, query, twin: str):
    """(number of rows, rows only in Spark, rows only in the twin)."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(twin)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    assert sorted(columns) == sorted(df.columns), (sorted(columns), sorted(df.columns))
    return sum(mine.values()), mine - theirs, theirs - mine


def main(argv) -> int:
    import __spark_entry__ as entry
    from leafscan.session import session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    bad = 0
    for name, query in entry.queries().items():
        if name not in entry.oracle_sql() or len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            n, extra, missing = compare(spark, db, sf_dir, query, entry.oracle_sql()[name])
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        ok = not extra and not missing
        bad += not ok
        print(f"{'ok   ' if ok else 'DIFF '} {name}: {n} rows, {time.time() - start:.1f} s", flush=True)
        if not ok:
            print("   spark only", sum(extra.values()), list(extra.items())[:4])
            print("   twin only ", sum(missing.values()), list(missing.items())[:4], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
