"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``; every query is executed in full into Spark's
``noop`` sink (no collect to the driver), once to warm up and then
``$BENCH_RUNS`` times (default 3); the median wall time is reported.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from geolex.plans import catalog  # noqa: E402
from geolex.session import TEXT_PARTITIONS, get_spark, remove_cuts  # noqa: E402

HEADLINE = (
    "r1_word_regression",      # X3: word model over all posts (flagship)
    "w4_top_words",            # X3 report
    "r10_evaluate",            # X2: split, train, classify, evaluate
    "x4_score_saved_model",    # X4: score all users with a model
    "a3_user_word_share",      # A3: user profiles
    "r11_tfidf",               # X7: sentence TF-IDF
    "x1_person_records",       # X1: JSON posts -> resolved person records
    "j3_nearest_zip",          # J3: grid nearest-zip join
    "t11_trim_words",          # T4/T11 over every token
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or list(HEADLINE)
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                      extra={"spark.ui.showConsoleProgress": "false",
                             "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g"),
                             TEXT_PARTITIONS: str(cpus * 2)})
    qs = catalog.queries()
    times = {}
    for name in names:
        def run():
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            remove_cuts(spark)
            return took
        run()
        times[name] = round(statistics.median(run() for _ in range(runs)), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "median_wall_time_sum", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
