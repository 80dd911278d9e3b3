"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``, forces the full result with the ``noop`` sink (no
collect to the driver), and prints one JSON line:

    {"metric": "total_query_seconds", "value": N, "unit": "sec",
     "queries": {"name": sec, ...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# The headline set: the two end-to-end cluster jobs, the cleaning pipeline
# and its profile, the roll-up and top-k, the upserts, the ingest (batch and
# streaming merge), the JSON source, the semi join, the ML building blocks
# and a full scan of the largest table.
HEADLINE = [
    "slum_report", "electricity_report", "preprocess", "null_profile", "numeric_profile",
    "rollup_city", "impute_split", "top_k_wards", "semi_join_distinct", "exclude_entities",
    "upsert_keys", "upsert_partitioned", "insert_partition_dynamic", "ingest_silver",
    "stream_ingest", "json_flatten", "csv_dir_scan", "minmax_scale", "kmeans_clusters",
    "silhouette", "pca_2d", "rank_labels", "reconcile_counts", "format_scan", "stream_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    from medallion.session import build_session
    from medallion.queries import QUERIES

    extra = {"spark.driver.memory": os.environ.get("BENCH_MEM", "4g")}
    if os.environ.get("BENCH_EVENT_LOG"):
        # stage and task times for later study, written to a scratch folder
        extra.update({"spark.eventLog.enabled": "true",
                      "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = build_session(f"local[{cpus}]", app="medallion-bench",
                          shuffle_partitions=max(8, int(cpus) * 2), extra=extra)
    # Warm the JVM once (class loading, JIT, ML and codegen caches) with the
    # flagship job on the smallest scale; its time is reported apart.
    t0 = time.perf_counter()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    QUERIES["slum_report"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    warmup = round(time.perf_counter() - t0, 3)

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "warmup_sec": warmup,
    }))


if __name__ == "__main__":
    main()
