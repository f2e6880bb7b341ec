"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8); BENCH_RUNS: timed
runs of each query (default 10, of which the first, the fastest and the slowest don't count; of fewer the slowest
doesn't).  ``value`` is the sum over the queries.  ``steps`` has the time to the first snapshot, the time to the last
one and the plain query's time in the mode that reads one written partition after the other.  ``sizes`` compares, for
each of BENCH_SIZES (rows of a partition, separated by commas), the plain query with its partitions one by one, in
milliseconds as the report has them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from statistics import mean

from pyspark.sql import DataFrame, SparkSession

QUERIES = [
    "prog_group_flag", "prog_avg_global", "prog_confidence_group", "prog_distinct_cols", "prog_having_snapshot", "prog_order_topk",
    "prog_join_2way", "prog_join_4way", "prog_join_product", "prog_in_subquery", "view_future_group_one", "view_future_where_two_or",
    "view_outer_window", "demo_origin", "demo_view_time", "final_exact",
    *[f"ssb_q{n}" for n in ("1_1", "1_2", "1_3", "2_1", "2_2", "2_3", "3_1", "3_2", "3_3", "3_4", "4_1", "4_2", "4_3")],
    *[f"ssbflat_q{n}" for n in ("1_1", "2_1", "3_1", "4_1")],
]
PLAIN = """SELECT l_returnflag, avg(l_quantity), sum(l_extendedprice), count(l_quantity) FROM lineitem GROUP BY l_returnflag"""


def timed(run: Callable[[], object]) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def protocol(run: Callable[[], object], runs: int) -> float:
    """Mean seconds; of ten runs or more the first, the fastest and the slowest don't count."""
    times = [timed(run) for _ in range(runs)]
    return mean(sorted(times[1:])[1:-1]) if runs >= 10 else mean(sorted(times)[: max(1, runs - 1)])


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def by_partitions(spark: SparkSession, df: DataFrame, size: int, runs: int) -> tuple[int, int]:
    """Sum and mean in milliseconds of the query's times over written partitions of ``size`` rows each."""
    from stepwise.session import ProgressiveSession
    from stepwise.streaming.state import discard, new_folder

    s, path = ProgressiveSession(spark), new_folder(spark, "bench")
    s.register("bench_li", df)
    ready = s.prepare_table("bench_li", partition_size=size, path=path)
    times = []
    for k in range(ready.partitions):
        ready.data.where(f"_partition = {k}").createOrReplaceTempView("bench_partition")
        times.append(1000 * protocol(lambda: drain(spark.sql(PLAIN.replace("lineitem", "bench_partition"))), runs))
    discard(spark, path)
    return round(sum(times)), round(mean(times))


def main() -> None:
    from stepwise import workloads
    from stepwise.sources.files import report_lines

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "10"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = workloads.queries()
    prepare = timed(lambda: (workloads.session(spark, sf_dir), workloads.session(spark, sf_dir, "product")))
    drain(queries[QUERIES[0]](spark, sf_dir))  # code is compiled before anything is timed
    seconds = {}
    for name in QUERIES:
        seconds[name] = round(protocol(lambda name=name: drain(queries[name](spark, sf_dir)), runs), 3)
        print(name, seconds[name], file=sys.stderr)

    result = workloads.session(spark, sf_dir, "stored").sql(workloads.SPECS["prog_group_flag"][0])
    drain(next(result.snapshots()).df)
    began, marks = time.perf_counter(), []
    for shot in result.snapshots():
        drain(shot.df)
        marks.append(time.perf_counter() - began)
    plain = protocol(lambda: drain(spark.sql(PLAIN)), runs)
    sizes = {}
    for size in map(int, os.environ.get("BENCH_SIZES", "100000,300000").split(",")):
        sizes[size] = by_partitions(spark, workloads.session(spark, sf_dir).tables["li"], size, min(runs, 3))
        print(report_lines([("l_returnflag", round(plain * 1000), *sizes[size])]), file=sys.stderr)
    steps = {"first_snapshot": marks[0], "last_snapshot": marks[-1], "plain_query": plain, "prepare": prepare, "mean_step": marks[-1] / len(marks)}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "steps": {k: round(v, 3) for k, v in steps.items()},
                "sizes": {k: dict(zip(("partitions_sum_ms", "partitions_avg_ms"), v, strict=True)) for k, v in sizes.items()},
            }
        )
    )


if __name__ == "__main__":
    main()
