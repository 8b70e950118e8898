"""Benchmark the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is timed from building its plan to the end of a full execution (noop sink, every
row produced). ``prepare`` builds the prepared tables (index, conformance, truth, splits)
once; the later queries read them, as the reference prepares once and evaluates many times.

Before timing, the same queries run once on the smallest data set (``$BENCH_WARMUP_DIR``,
default sf0.001) to warm the JVM and Spark's code-generation cache; nothing computed there
is reused at the timed scale (prepared tables are keyed by input folder).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flow_conformance",     # core detector from raw events, cold (own index + conformance)
    "keyword_match",
    "group_traces",
    "template_ids",
    "split_train_val",
    "surprise_detect",
    "conformance_eval",
    "keyword_eval",
    "compare_runs",
    "classification_metrics",
    "auroc",
    "token_to_line_loss",
    "repeat_runs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from logweave.plans import base as B
    from logweave.plans.catalog import QUERIES
    from logweave.session import get_spark

    spark = get_spark(f"local[{cpus}]", int(cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and warm != sf_dir and os.path.isdir(warm):  # JVM / codegen warm-up, not timed
        for df in B.prepared(spark, warm).values():
            df.write.format("noop").mode("overwrite").save()
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    t0 = time.time()
    prep = B.prepared(spark, sf_dir)
    for df in prep.values():
        df.write.format("noop").mode("overwrite").save()
    times["prepare"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
