"""Times every registered query on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` local cores.

Each query runs ``$BENCH_RUNS`` times (2) into the ``noop`` sink, so that every row and column is
computed; the fastest run counts. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofspark.plans.catalog import QUERIES  # noqa: E402
from proofspark.session import local_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    QUERIES["reading_counts"](spark, folder).collect()
    best = {}
    for name in names:
        for _ in range(runs):
            begun = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begun
            best[name] = round(min(took, best.get(name, took)), 3)
    print(
        json.dumps(
            {
                "metric": f"total of {len(best)} queries, fastest of {runs} runs",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
