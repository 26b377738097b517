"""Times headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_ONLY a
comma-separated list of queries in place of the headline ones ("all" for all).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "risk_report", "risk_contributions", "risk_var_methods", "var_backtest", "sweep_selection", "lookahead_findings",
    "folds_leakage", "survivorship_audit", "sharpe_deflated", "ledger_category_summary", "ledger_category_rollup",
    "ledger_running_total", "ledger_time_buckets", "ledger_anomalies", "facts_original_by_year", "suite_build",
    "suite_scores", "lineage_metric_cards", "lineage_verify", "banned_find", "context_fit", "page_paragraphs",
    "stream_sessions", "stream_dedup",
]


def main() -> None:
    from evidentia.catalogue import load
    from evidentia.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    only = os.environ.get("BENCH_ONLY", "")
    names = list(queries) if only == "all" else only.split(",") if only else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in names:
        t0 = time.time()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # a failing query is reported, the others still run
            print(f"{name}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
            times[name] = None
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "headline query wall time", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
