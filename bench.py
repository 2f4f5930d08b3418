"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each tracked query runs beside its plain twin (the same values, no tags), both written to
the noop sink; `overhead` is their ratio of medians over warm runs.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from provenant import catalogue  # noqa: E402
from provenant.plans import label, track  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plans(spark: SparkSession) -> dict:
    """name -> a function of labels or not, giving the same DataFrame."""
    c = F.col

    def tables(own: bool):
        t = catalogue.Tables(spark, SF_DIR)
        return (t.orders, t.customer, t.lineitem, t.documents) if own else tuple(map(t.raw, ("orders", "customer", "lineitem", "documents")))

    def scan_filter(own):
        _, _, l, _ = tables(own)
        return l.where("l_quantity < 24").select("l_orderkey", (c("l_extendedprice") * (1 - c("l_discount"))).alias("revenue"))

    def group_agg(own):
        _, _, l, _ = tables(own)
        return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("s"), F.avg("l_discount").alias("d"), F.count("*").alias("n"))

    def high_cardinality_agg(own):
        _, _, l, _ = tables(own)
        return l.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"), F.max("l_shipdate").alias("d"))

    def join_agg(own):
        o, u, _, _ = tables(own)
        return o.join(u, c("o_custkey") == c("c_custkey")).groupBy("c_name").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))

    def window_sum(own):
        from pyspark.sql import Window

        o, _, _, _ = tables(own)
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
        return o.select("o_orderkey", F.sum("o_totalprice").over(w).alias("s"))

    def explode_words(own):
        _, _, _, d = tables(own)
        return d.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def distinct_sort(own):
        o, _, _, _ = tables(own)
        return o.select("o_custkey", "o_orderpriority", "o_totalprice").distinct().orderBy("o_totalprice")

    return {f.__name__: f for f in (scan_filter, group_agg, high_cardinality_agg, join_agg, window_sum, explode_words, distinct_sort)}


def timed(make) -> tuple[float, float]:
    """(median seconds with planning, of which planning) over warm runs."""
    total, planning = [], []
    for k in range(RUNS + 1):
        start = time.perf_counter()
        df = make()
        middle = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        if k:
            total.append(time.perf_counter() - start)
            planning.append(middle - start)
    return statistics.median(total), statistics.median(planning)


def main() -> None:
    spark = session()
    label(spark.range(1), ["id"])
    queries, plain, overhead, walk = {}, {}, {}, {}
    for name, make in plans(spark).items():
        plain[name], _ = timed(lambda: make(False))  # noqa: B023
        queries[name], walk[name] = timed(lambda: track(make(True)).to_flat())  # noqa: B023
        overhead[name] = round(queries[name] / plain[name], 2)
    rounded = lambda d: {k: round(v, 3) for k, v in d.items()}
    print(
        json.dumps(
            {
                "metric": "tracked_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": rounded(queries), "plain": rounded(plain),
                "overhead": overhead, "plan_walk": rounded(walk), "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
