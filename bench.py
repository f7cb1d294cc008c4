"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every query is run once to warm up on the smallest data set
where that exists, then timed once, results written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowspark import catalog  # noqa: E402
from flowspark.operators import forest  # noqa: E402
from flowspark.staging import release  # noqa: E402

HEADLINE = ["threat_ranking", "edge_table", "pr_curve", "weights_3", "pagerank", "campaigns", "split_rows",
            "column_percentiles", "source_summary_ens", "alert_distribution", "flow_id_match", "iforest_flow_scores"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowspark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    seconds = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            run(catalog.QUERIES[name](spark, warm))
        t0 = time.perf_counter()
        run(catalog.QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - t0, 3)

    # the forest at its defaults, 400 trees of unlimited depth: fit, load, then score alone
    rows = catalog._model_rows(spark, sf_dir)
    t0 = time.perf_counter()
    model = forest.fit_forest(rows.where("split_binary = 'train'"), catalog.FEATURES, catalog.DEFAULT)
    seconds["rf_fit"] = round(time.perf_counter() - t0, 3)
    n = rows.count()
    run(forest.score_attacks(model, rows.limit(200), catalog.FEATURES, ["sample_id"]))
    t0 = time.perf_counter()
    run(forest.score_attacks(model, rows, catalog.FEATURES, ["sample_id"]))
    scoring = time.perf_counter() - t0
    seconds["rf_score"] = round(scoring, 3)
    release(spark)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "forest_400_deep_trees_flows_per_second": round(n / scoring, 1)}))


if __name__ == "__main__":
    main()
