"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables and BENCH_CPUS
the local cores. The large tables are first laid out in one file per core, as a
data set of many files would be; no query changes its plan for a small one. Each
query is then built, run once to warm up, and timed (building the plan included)
with its whole result consumed by a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tallyroute.catalog import all_queries

HEADLINE = [
    "v4_label_requests", "v2_vote_sums", "d2_time_detector", "d4_person_detector",
    "d5_location_detector", "d6_quantity_detector", "j2_gazetteer_match", "e6_label_prf",
    "e12_evaluation_job", "k5_validation_summary", "k1_errors", "c8_typed_table",
    "a1_by_domain", "a8_chunk_profile", "w3_batch_ids", "w7_balanced_sample",
    "w10_entity_spans", "t1_normalize", "t10_keywords", "t14_language", "t22_analysis",
    "u1_apply_rows", "r1_stream_labels", "j2_gazetteer_match_joined",
]
LARGE = ("events", "documents")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # past this size the JVM does not compile a generated method at all
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    names = sys.argv[1:] or HEADLINE

    laid_out = tempfile.mkdtemp(prefix="bench-")
    for file in sorted(os.listdir(folder)):
        if file.removesuffix(".parquet") in LARGE:
            spark.read.parquet(f"{folder}/{file}").repartition(int(cpus)).write.parquet(f"{laid_out}/{file}")
        else:
            os.symlink(f"{folder}/{file}", f"{laid_out}/{file}")

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, laid_out).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(min(run(name) for _ in range(2)), 3)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    result = {
        "metric": "headline queries, wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1],
        "requests": rows,
        "items_per_second": {n: round(rows / s) for n, s in seconds.items() if not n.startswith("t1")},
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
