"""Benchmark: the full audit over the code corpus of ``$BENCH_SF_DIR``, stage by stage.

Prints one JSON line. Stages that write an intermediate table are timed with the write; the later
ones read it, so the sum is one complete audit.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from leafscan import Audit  # noqa: E402
from leafscan.operators import text_rules  # noqa: E402
from leafscan.plans import reports  # noqa: E402
from leafscan.session import session, settle  # noqa: E402
from leafscan.sources import corpus  # noqa: E402


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    drain(spark.range(1000).groupBy(F.col("id") % 7).count())
    files = timed("source_files", lambda: settle(corpus.code_corpus(spark, sf_dir), "source_files"))
    a = Audit(files)
    timed("sql_rules", lambda: drain(text_rules.sql_hits(a.files)))
    timed("text_pass", lambda: a.text_facts)
    timed("token_job", lambda: a.facts)
    timed("raw_findings", lambda: a.raw_findings)
    timed("units_and_chains", lambda: a.discovered)
    timed("grouped_findings", lambda: a.findings)
    for name in ("signals", "unit_scores", "unit_deductions", "unit_categories", "project_scores", "project_categories",
                 "project_metrics", "top_units", "issues", "recommendations", "next_actions", "gate_verdicts"):
        timed(name, lambda: drain(getattr(a, name)))
    timed("audit_summary", lambda: drain(reports.audit_summary(a)))
    timed("audit_json", lambda: drain(reports.audit_json(a)))
    print(json.dumps({
        "metric": "pagination_audit_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
