"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). `python bench.py --pairs` times the two forms of the
operators that have a plain and a scalable one instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from martlib.operators import joins as J
from martlib.operators import windows as W
from martlib.plans import flows, load_queries, registry, shop_queries
from martlib.session import get_spark
from martlib.sources.readers import lines_for_day, table, trading_days
from martlib.sources.scratch import new_folder
from martlib.sources.writers import force_compute

HEADLINE = (
    "monthly_revenue_by_region revenue_rollup weekend_split customer_rfm cohort_retention top_parts_by_region invoices latest_per_customer price_report segment_lift "
    "scd2_rebuild pit_join then_vs_current guest_resolution upsert_last_wins replace_batch incremental_lookback table_diff quality_report table_checks reconcile_layers fk_orphans "
    "median_by_month year_from_wraps daily_funnel product_daily error_episodes reliability area_hour"
).split()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def pairs(spark, d: str) -> dict[str, float]:
    """Plain and scalable forms of the same result."""
    sales = shop_queries.sales(spark, d).groupBy("customer_id").agg(F.sum("revenue").alias("revenue")).persist()
    fact = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("grp"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    v = shop_queries.versions(spark, d).select(F.col("o_custkey").alias("k"), F.lit(None).cast("string").alias("g"), "valid_from", "valid_to").persist()
    on = ((fact["o_custkey"] == v["k"]) & F.to_date("o_orderdate").between(v["valid_from"], v["valid_to"])) | (fact["o_custkey"].isNull() & v["k"].isNull() & (fact["grp"] == v["g"]))
    lines, parts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity"), table(spark, d, "part")
    force_compute(v)
    force_compute(sales)
    forms = {
        "percent_rank, one global window": lambda: force_compute(sales.select(F.percent_rank().over(W.Window.orderBy("revenue")))),
        "percent_rank, prefix counts": lambda: force_compute(W.percent_rank_scores(sales, {"s": "revenue"})),
        "member, two conditions joined by OR": lambda: force_compute(fact.limit(3000).join(v.limit(3000), on)),
        "member, split and union": lambda: force_compute(shop_queries.guest_resolution(spark, d)),
        "join, plain": lambda: force_compute(lines.join(parts, "p_partkey")),
        "join, salted": lambda: force_compute(J.salted_join(lines, parts, "p_partkey", 8)),
    }
    return {name: timed(run) for name, run in forms.items()}


def loads(spark, d: str) -> dict[str, float]:
    """The warehouse from all lines in one pass, with its checks; then the last day again, and the last 50 days again in one run."""
    feed, loader = load_queries.feed(spark, d), flows.DailyLoader(spark, new_folder(spark, "bench"))
    days = [str(r["day"]) for r in trading_days(feed, "invoiced_at").orderBy("day").collect()]
    last = days[-1]
    forms = {"all days in one pass": lambda: loader.rebuild(feed), "one daily batch": lambda: loader.run_batch(lines_for_day(feed, "invoiced_at", last, ["line_id"]), last), "50 days in one run": lambda: loader.backfill(feed, days[-50:])}
    return {name: timed(run) for name, run in forms.items()}


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    force_compute(table(spark, d, "lineitem").groupBy("l_returnflag").count())  # start the executors
    if "--pairs" in sys.argv:
        print(json.dumps({"metric": "plain and scalable forms", "unit": "sec", "queries": pairs(spark, d), "sf": d}))
        return
    took = {}
    for name in HEADLINE:
        took[name] = timed(lambda q=registry.QUERIES[name]: force_compute(q(spark, d)))
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "loads": loads(spark, d), "sf": d}))


if __name__ == "__main__":
    main()
