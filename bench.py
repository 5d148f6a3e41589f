"""Headline jobs, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.session import build_session  # noqa: E402
from plumbline.workloads.registry import QUERIES, prepare  # noqa: E402

HEADLINE = [
    "profile_lineitem", "profile_approx", "top_values_orders", "mask_partial", "documents_pii_hits", "pii_combined",
    "quality_overall", "fk_containment", "blast_radius_all", "lineage_cycles", "sql_lineage_edges", "anomalies_all",
    "forecast_monthly", "zscore_outliers", "top10_customers", "metric_revenue_by_region", "agg_multi", "semantic_search",
    "recommendations", "policy_compliance", "sql_asof", "sql_running_sum", "cdc_current_state", "stream_kpi_hourly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    # start-up costs (class loading, first code generation) are not part of any query
    for warm_up in ("profile_rowcount", "profile_orders"):
        QUERIES[warm_up](spark, sf_dir).collect()
    prepare(spark, sf_dir)  # tables that stand for a catalog and its logs are inputs
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:26s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
