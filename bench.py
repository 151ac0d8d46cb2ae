"""Times every query at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is run to its last row without keeping the result, twice: `queries`
has the better time, `first_run` the time including code generation and JIT.
Recording the derived log is timed on its own, once, as `record_log`; the
queries then read the stored log, as they would in use.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tracewell.session import configure
from tracewell.workload.derived_log import stored_log
from tracewell.workload.registry import QUERIES


def session(cpus: str) -> SparkSession:
    spark = (
        configure(SparkSession.builder)
        .master(f"local[{cpus}]")
        .appName("tracewell-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tracewell-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count())))
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()

    seconds = {"record_log": timed(lambda: stored_log(spark, sf_dir))}
    first_run = dict(seconds)
    for name in names or QUERIES:
        run = QUERIES[name]
        times = [
            timed(lambda: run(spark, sf_dir).write.format("noop").mode("overwrite").save())
            for _ in range(2)
        ]
        first_run[name], seconds[name] = times[0], min(times)
    result = {
        "metric": "total time of all queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_run": first_run,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
