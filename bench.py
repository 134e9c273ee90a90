"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once cold and then warm runs into the ``noop`` sink (the whole
result is computed, nothing is collected); the reported time per query is the
median warm run.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parlance.plans.catalog import REGISTRY  # noqa: E402
from parlance.session import build_session  # noqa: E402

HEADLINE = [
    "joint_goal_scoring",
    "joint_goal_accuracy",
    "turn_class_prf",
    "span_f1_macro",
    "bio_spans",
    "example_vote",
    "sample_per_class",
    "split_stratified",
    "cumulative_history",
    "build_turns_multidomain",
    "normalise_text",
    "merge_corpus",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = int(os.environ.get("BENCH_WARM", "3"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in REGISTRY]
    spark = build_session(f"local[{cpus}]", int(cpus) * 2, app="parlance-bench")
    times, cold, errors = {}, {}, {}
    for name in names:
        fn = REGISTRY[name][0]
        runs = []
        try:
            for i in range(1 + warm):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                if i == 0:
                    cold[name] = round(dt, 3)
                else:
                    runs.append(dt)
            times[name] = round(statistics.median(runs) if runs else cold[name], 3)
        except Exception as e:  # noqa: BLE001 -- one failing query must not lose the whole line
            errors[name] = str(e)[:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "sum_median_warm_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "cold": cold, "sf": sf, "cpus": int(cpus)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
