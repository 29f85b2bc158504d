"""Bench: headline jobs on $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints ONE JSON line.

Each query is run to completion into Spark's ``noop`` sink (all rows are
computed, nothing is collected to the driver).  Every query runs twice on the
same data: the first (cold: JVM start, JIT compilation, Python workers) is
reported under ``cold``, the second is the timed value.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from taxomatch.plans import catalog  # noqa: E402
from taxomatch.session import local_session  # noqa: E402

HEADLINE = [
    "classify_direct",
    "classify_vote",
    "classify_ensemble",
    "search_report",
    "tfidf_direct",
    "words_direct",
    "mean_word_vectors",
    "vocab_counts",
    "clean_text",
    "chunk_words",
    "category_docs",
    "product_text",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2)
    cold = {name: round(run(spark, name, sf_dir), 3) for name in names}
    times = {name: round(run(spark, name, sf_dir), 3) for name in names}
    n_products = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 4 != 0").count()
    total = round(sum(times.values()), 3)
    out = {
        "metric": "total_wall_time",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).replace("sf", "")),
        "cpus": int(cpus),
        "cold": cold,
        "cold_total": round(sum(cold.values()), 3),
        "products_per_sec": {
            k: round(n_products / times[k], 1)
            for k in ("classify_direct", "classify_vote", "classify_ensemble") if k in times
        },
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
