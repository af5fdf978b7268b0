"""Run the registered queries once each and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma-separated choice. Results go to the noop sink, so every row and
column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from tallyloom.session import local_session
from tallyloom.workload.queries import all_queries
from tallyloom.workload.views import SCAN_TASKS


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, shuffle_partitions=partitions, memory=os.environ.get("BENCH_MEMORY", "16g"))
    # the given tables are files of one row group each: ask for as many tasks behind their scan as there are cores
    spark.conf.set(SCAN_TASKS, str(partitions))
    catalog = all_queries()
    chosen = {k: v for k, v in catalog.items() if not wanted or k in wanted}

    # one untimed run loads classes and starts the executor threads
    catalog["gold_order_cost"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name, run in chosen.items():
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
                "shuffle_partitions": partitions,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
