"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3). Each query is built and executed in full (noop sink), once to warm
up and then BENCH_RUNS times; the median counts.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from flowlens import fixtures  # noqa: E402
from flowlens.catalog import catalog  # noqa: E402
from flowlens.operators import features, preparation  # noqa: E402
from flowlens.plans import addresses, rules, tables, traffic  # noqa: E402

# Reports over the large flow table (lineitem).
LARGE = {
    "ip_features": features.ip_features,
    "full_features": lambda df: features.full_features(df).data,
    "ip_stats": addresses.ip_stats,
    "port_scanners": addresses.port_scanners,
    "top_external_sources": addresses.top_external_sources,
    "overview_metrics": traffic.overview_metrics,
    "summary_metrics": traffic.summary_metrics,
    "port_range_pivot": traffic.port_range_pivot,
    "flow_hierarchy": traffic.flow_hierarchy,
    "traffic_over_time": traffic.traffic_over_time,
    "activity_heatmap": traffic.activity_heatmap,
    "top_ports": traffic.top_ports,
    "rule_usage": rules.rule_usage,
    "rule_port_action": rules.rule_port_action,
    "rule_port_matrix": rules.rule_port_matrix,
    "describe": lambda df: tables.describe(df, ["portdst", "regle"]),
    "correlation_matrix": lambda df: preparation.correlation_matrix(features.full_table(df)),
}
# Catalogue queries over the other tables.
CATALOGUE = (
    "scan_kernel_log",
    "scan_firewall_export",
    "infer_log_year",
    "search",
    "validate_flows",
    "roc_auc",
    "stratified_folds",
    "knn_leave_one_out",
    "dbscan",
    "isolation_forest",
    "kmeans",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("flowlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="flowlens-bench-"))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: lambda b=build: b(fixtures.flows_large(spark, sf_dir)) for name, build in LARGE.items()}
    known = catalog()
    jobs |= {name: lambda n=name: known[n].run(spark, sf_dir) for name in CATALOGUE}
    only = sys.argv[1:]
    seconds = {}
    for name, job in jobs.items():
        if only and name not in only:
            continue
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "total of median query seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


main()
