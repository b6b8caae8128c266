"""Retail queries on the test tables: lines and orders as sales, nations as countries, parts as products.

l_returnflag 'R' plays cancellation (negative revenue), o_orderpriority is the attribute that changes over time, and orders
whose customer number is divisible by 7 play guests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.functions import columns as C
from martlib.operators import aggregates as A
from martlib.operators import history as H
from martlib.operators import joins as J
from martlib.operators import windows as W
from martlib.operators.quantiles import exact_median
from martlib.plans import marts as K
from martlib.sources.readers import lines_for_day, table
from martlib.sources.scratch import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- the mapping -------------------------------------------------------------------------------------------------------


def customers(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", F.col("n_name").alias("country"), F.col("r_name").alias("region"))


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their order: invoice_no, customer_id, invoiced_at, date_key, stock_code, quantity, revenue, line_type."""
    revenue = C.money(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    cancelled = F.col("l_returnflag") == "R"
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("stock_code"), F.col("l_quantity").alias("quantity"), F.when(cancelled, -revenue).otherwise(revenue).alias("revenue"), F.when(cancelled, "cancellation").otherwise("sale").alias("line_type"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("invoice_no"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("invoiced_at"), C.date_key("o_orderdate").alias("date_key"))
    return lines.join(orders, F.col("l_orderkey") == F.col("invoice_no")).drop("l_orderkey")


def regional_sales(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).join(customers(spark, d), F.col("customer_id") == F.col("c_custkey"))


_REV = "round(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,6)), 2)::DECIMAL(18,2)"
SALES = f"""s AS (SELECT o_orderkey AS invoice_no, o_custkey AS customer_id, o_orderdate AS invoiced_at, l_partkey AS stock_code, l_quantity AS quantity,
  CASE WHEN l_returnflag = 'R' THEN -{_REV} ELSE {_REV} END AS revenue, CASE WHEN l_returnflag = 'R' THEN 'cancellation' ELSE 'sale' END AS line_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
REGIONAL = SALES + """, r AS (SELECT s.*, n_name AS country, r_name AS region, c_mktsegment FROM s JOIN customer ON customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

# --- marts -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {REGIONAL}, m AS (SELECT date_trunc('month', invoiced_at)::DATE AS month, region, sum(revenue) FILTER (WHERE line_type = 'sale') AS gross_sales,
  -sum(revenue) FILTER (WHERE line_type = 'cancellation') AS cancellations, sum(revenue) AS net_revenue, count(DISTINCT invoice_no) FILTER (WHERE line_type = 'sale') AS orders,
  count(DISTINCT customer_id) AS active_customers FROM r GROUP BY ALL)
SELECT month, region, gross_sales::DECIMAL(18,2) AS gross_sales, cancellations::DECIMAL(18,2) AS cancellations, net_revenue::DECIMAL(18,2) AS net_revenue, orders, active_customers,
  round(100 * (net_revenue::DOUBLE / nullif(lag(net_revenue::DOUBLE) OVER (PARTITION BY region ORDER BY month), 0) - 1), 1) AS net_revenue_mom_pct FROM m""")
def monthly_revenue_by_region(spark, d):
    return K.monthly_revenue(regional_sales(spark, d))


@query(f"""WITH {REGIONAL} SELECT year(invoiced_at)::INT AS year, quarter(invoiced_at)::INT AS quarter, region, sum(revenue)::DECIMAL(18,2) AS net_revenue FROM r
GROUP BY GROUPING SETS ((year(invoiced_at), quarter(invoiced_at), region), (year(invoiced_at), region), (region))""")
def revenue_rollup(spark, d):
    return K.revenue_rollup(regional_sales(spark, d), H.dim_date_of(table(spark, d, "orders"), "o_orderdate"))


@query(f"""WITH {SALES} SELECT isodow(invoiced_at) >= 6 AS is_weekend, count(DISTINCT invoice_no) AS invoices, sum(revenue)::DECIMAL(18,2) AS net_revenue FROM s GROUP BY 1""")
def weekend_split(spark, d):
    return K.weekend_split(sales(spark, d), H.dim_date_of(table(spark, d, "orders"), "o_orderdate"))


@query(f"""WITH {SALES}, c AS (SELECT customer_id, max(invoiced_at) AS last_purchase_at, count(DISTINCT invoice_no) FILTER (WHERE line_type = 'sale') AS orders, sum(revenue)::DECIMAL(18,2) AS net_revenue
  FROM s GROUP BY customer_id HAVING sum(revenue) > 0),
p AS (SELECT *, least(5, 1 + floor(5 * percent_rank() OVER (ORDER BY last_purchase_at)))::INT AS recency_score, least(5, 1 + floor(5 * percent_rank() OVER (ORDER BY orders)))::INT AS frequency_score,
  least(5, 1 + floor(5 * percent_rank() OVER (ORDER BY net_revenue)))::INT AS monetary_score FROM c)
SELECT *, CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions' WHEN recency_score >= 3 AND frequency_score >= 3 THEN 'Loyal'
  WHEN recency_score >= 4 AND frequency_score <= 2 THEN 'New / promising' WHEN recency_score <= 2 AND frequency_score >= 3 THEN 'At risk' WHEN recency_score <= 2 AND frequency_score <= 2 THEN 'Lost'
  ELSE 'Need attention' END AS segment FROM p""")
def customer_rfm(spark, d):
    return K.customer_rfm(sales(spark, d))


@query(f"""WITH {SALES}, a AS (SELECT DISTINCT customer_id, date_trunc('month', invoiced_at)::DATE AS month FROM s WHERE line_type = 'sale'),
f AS (SELECT customer_id, min(month) AS cohort_month FROM a GROUP BY 1), c AS (SELECT cohort_month, date_diff('month', cohort_month, month)::INT AS months_since_first, count(*) AS active_customers FROM a JOIN f USING (customer_id) GROUP BY ALL)
SELECT *, first_value(active_customers) OVER w AS cohort_size, round(100.0::DOUBLE * active_customers / first_value(active_customers) OVER w, 1) AS retention_pct FROM c WINDOW w AS (PARTITION BY cohort_month ORDER BY months_since_first)""")
def cohort_retention(spark, d):
    return K.cohort_retention(sales(spark, d))


@query(f"""WITH {REGIONAL}, g AS (SELECT region, stock_code, sum(revenue)::DECIMAL(18,2) AS revenue FROM r GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY region ORDER BY revenue DESC)::INT AS rank_in_region FROM g)
SELECT * FROM k WHERE rank_in_region <= 10""")
def top_parts_by_region(spark, d):
    return K.top_products_by_region(regional_sales(spark, d), 10)


@query(f"""WITH {SALES} SELECT invoice_no, min(customer_id) AS customer_id, min(invoiced_at) AS invoiced_at, bool_or(line_type = 'cancellation') AS is_cancellation, count(*) AS lines, sum(quantity) AS units,
  sum(revenue)::DECIMAL(18,2) AS revenue FROM s GROUP BY invoice_no""")
def invoices(spark, d):
    staged = sales(spark, d).withColumns({"is_rejected": F.lit(False), "country": F.lit(None).cast("string")})
    return K.invoices(staged).drop("country")


@query("""SELECT c_mktsegment, o_orderpriority, o_orderkey, o_totalprice, rank::INT AS rank FROM (SELECT c_mktsegment, o_orderpriority, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 5""")
def top_orders_by_segment(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return W.top_n_per_group(j.select("c_mktsegment", "o_orderpriority", "o_orderkey", "o_totalprice"), ["c_mktsegment"], "o_totalprice", 5)


@query("""SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_customer(spark, d):
    return W.latest_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


@query("""SELECT o_orderpriority, count(*) AS orders, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share_pct FROM orders GROUP BY 1""")
def share_of_orders(spark, d):
    return A.share_of_total(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders")), "orders")


@query("""SELECT band, count(*) AS lines, round(100 * avg(l_discount), 1) AS avg_discount_pct FROM (SELECT l_discount,
  CASE WHEN l_quantity < 10 THEN '1: under 10' WHEN l_quantity < 25 THEN '2: 10-25' WHEN l_quantity < 40 THEN '3: 25-40' ELSE '4: 40+' END AS band FROM lineitem) GROUP BY band""")
def quantity_band_discount(spark, d):
    band = C.band("l_quantity", [10, 25, 40], ["1: under 10", "2: 10-25", "3: 25-40", "4: 40+"])
    return table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("lines"), F.round(100 * F.avg("l_discount"), 1).alias("avg_discount_pct"))


@query("""SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS lines, round(100 * avg((l_linestatus = 'F')::INT), 1) AS finished_pct, median(l_quantity) AS median_quantity FROM lineitem GROUP BY 1""")
def median_by_month(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.groupBy(C.month_key("l_shipdate").alias("month")).agg(F.count("*").alias("lines"), C.pct(F.col("l_linestatus") == "F").alias("finished_pct"), F.median("l_quantity").alias("median_quantity"))


@query("""SELECT s_name, count(*) AS rides, round(100 * avg((l_returnflag = 'R')::INT), 1) AS round_trip_pct FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name IS NOT NULL
GROUP BY s_name ORDER BY rides DESC, s_name LIMIT 10""")
def busiest_suppliers(spark, d):
    return K.busiest(table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")), "s_name", F.col("l_returnflag") == "R")


@query("""WITH p AS (SELECT p_brand AS symbol, l_shipdate::DATE AS trade_date, sum(CAST(l_extendedprice / l_quantity AS DECIMAL(18,6)))::DOUBLE / count(*) AS adj_close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
q AS (SELECT * FROM p WHERE trade_date > (SELECT max(trade_date) FROM p) - 365),
e AS (SELECT *, adj_close / lag(adj_close) OVER w - 1 AS r, max(adj_close) OVER (w ROWS UNBOUNDED PRECEDING) AS peak, avg(adj_close) OVER (w ROWS 49 PRECEDING) AS ma FROM q WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
SELECT symbol, min(trade_date) AS first_date, max(trade_date) AS last_date, max_by(adj_close, trade_date) AS last_close, round(100 * (max_by(adj_close, trade_date) / min_by(adj_close, trade_date) - 1), 4) AS return_pct,
  round(100 * stddev_samp(r) * sqrt(252), 4) AS volatility_pct, round(100 * min(adj_close / peak - 1), 4) AS max_drawdown_pct, max_by(adj_close > ma, trade_date) AS above_ma FROM e GROUP BY symbol""")
def price_report(spark, d):
    out = K.symbol_report(brand_prices(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in ("return_pct", "volatility_pct", "max_drawdown_pct")})


def brand_prices(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    mean = F.sum((F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,6)")).cast("double") / F.count("*")
    return j.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("trade_date")).agg(mean.alias("adj_close"))


@query("""WITH p AS (SELECT p_brand AS symbol, l_shipdate::DATE AS trade_date, sum(CAST(l_extendedprice / l_quantity AS DECIMAL(18,6)))::DOUBLE / count(*) AS adj_close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
e AS (SELECT symbol, trade_date, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM p) SELECT symbol, trade_date, round(r, 4) AS daily_return FROM e WHERE abs(r) > 0.25""")
def big_moves(spark, d):
    moves = W.daily_return(brand_prices(spark, d), ["symbol"], "trade_date", "adj_close")
    return moves.where(F.abs("daily_return") > 0.25).select("symbol", "trade_date", F.round("daily_return", 4).alias("daily_return"))


@query("""WITH c AS (SELECT o_orderpriority = '1-URGENT' AS converted, c_mktsegment, n_name, o_orderstatus, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT avg(converted::INT) AS overall FROM c), s AS (SELECT 'segment' AS dimension, c_mktsegment AS segment, converted FROM c UNION ALL SELECT 'nation', n_name, converted FROM c
  UNION ALL SELECT 'status', o_orderstatus, converted FROM c UNION ALL SELECT 'balance', balance, converted FROM c)
SELECT dimension, segment, count(*) AS calls, round(100 * avg(converted::INT), 1) AS conversion_pct, round(avg(converted::INT) / max(overall), 2) AS lift FROM s CROSS JOIN b GROUP BY ALL HAVING count(*) >= 300""")
def segment_lift(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    contacts = j.withColumn("converted", F.col("o_orderpriority") == "1-URGENT")
    return K.segment_lift(contacts, {"segment": "c_mktsegment", "nation": "n_name", "status": "o_orderstatus", "balance": C.band("c_acctbal", [0, 5000], ["debt", "low", "high"])}, "converted")


# --- history -----------------------------------------------------------------------------------------------------------

_VERSIONS = """d AS (SELECT o_custkey, o_orderdate::DATE AS day, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w THEN 1 ELSE 0 END AS ch FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
u AS (SELECT *, sum(ch) OVER (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING)::INT AS version_number FROM c),
g AS (SELECT o_custkey, version_number, any_value(o_orderpriority) AS o_orderpriority, min(day) AS valid_from FROM u GROUP BY ALL),
v AS (SELECT *, coalesce(lead(valid_from) OVER w - 1, DATE '9999-12-31')::DATE AS valid_to, lead(valid_from) OVER w IS NULL AS is_current FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY valid_from))"""


def versions(spark, d):
    return H.scd2_rebuild(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", ["o_orderkey"])


@query(f"WITH {_VERSIONS} SELECT o_custkey, version_number, o_orderpriority, valid_from, valid_to, is_current, md5(o_custkey || '-' || version_number) AS version_key FROM v")
def scd2_rebuild(spark, d):
    return versions(spark, d)


#: The merge replays the last days of the orders, on top of the history up to them.
REPLAY_DAYS = 5


@query(f"WITH {_VERSIONS} SELECT o_custkey, o_orderpriority, valid_from, valid_to, is_current FROM v")
def scd2_merge_replay(spark, d):
    orders = table(spark, d, "orders")
    last = [r["day"] for r in orders.select(F.to_date("o_orderdate").alias("day")).distinct().orderBy(F.desc("day")).limit(REPLAY_DAYS).collect()][::-1]
    before = H.scd2_rebuild(orders.where(F.to_date("o_orderdate") < F.lit(last[0])), "o_custkey", "o_orderpriority", "o_orderdate", ["o_orderkey"])
    start = before.select("o_custkey", "o_orderpriority", "valid_from", "valid_to", "is_current")
    return H.scd2_replay(orders, "o_custkey", "o_orderpriority", "o_orderdate", ["o_orderkey"], [str(x) for x in last], start)


@query(f"WITH {_VERSIONS} SELECT o_orderkey, o.o_custkey, o_orderdate, v.o_orderpriority AS priority_then, version_number FROM orders o JOIN v ON o.o_custkey = v.o_custkey AND o_orderdate::DATE BETWEEN valid_from AND valid_to")
def pit_join(spark, d):
    v = versions(spark, d).select("o_custkey", F.col("o_orderpriority").alias("priority_then"), "version_number", "valid_from", "valid_to")
    out = J.point_in_time_join(table(spark, d, "orders"), v, "o_custkey", "o_orderdate", "inner")
    return out.select("o_orderkey", "o_custkey", "o_orderdate", "priority_then", "version_number")


@query(f"WITH {_VERSIONS} SELECT o_orderkey, o.o_custkey, o_orderdate, v.o_orderpriority AS priority_then, version_number FROM orders o JOIN v ON o.o_custkey = v.o_custkey AND o_orderdate::DATE BETWEEN valid_from AND valid_to")
def as_of_join(spark, d):
    """pit_join by a merge instead of a range condition."""
    v = versions(spark, d).select("o_custkey", F.col("o_orderpriority").alias("priority_then"), "version_number", "valid_from", "valid_to")
    return J.as_of_join(table(spark, d, "orders"), v, "o_custkey", "o_orderdate", "inner").select("o_orderkey", "o_custkey", "o_orderdate", "priority_then", "version_number")


@query("""WITH p AS (SELECT p_partkey, DATE '1992-01-01' + (p_partkey % 2000)::INT AS valid_from, DATE '1992-01-01' + (p_partkey % 2000)::INT + 365 AS valid_to, p_brand FROM part)
SELECT p_brand, count(*) AS lines, sum(l_quantity) AS units FROM lineitem LEFT JOIN p ON l_partkey = p_partkey AND l_shipdate::DATE BETWEEN valid_from AND valid_to GROUP BY 1""")
def as_of_closed_ends(spark, d):
    """Each part has a price list for a year; before and after it a line finds none."""
    start = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("p_partkey") % 2000).cast("int"))
    lists = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), start.alias("valid_from"), F.date_add(start, 365).alias("valid_to"), "p_brand")
    return J.as_of_join(table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity"), lists, "l_partkey", "l_shipdate").groupBy("p_brand").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("units"))


@query("""SELECT 'day' AS period, o_orderdate::DATE AS starts_on, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 2 UNION ALL SELECT 'month', date_trunc('month', o_orderdate)::DATE, count(DISTINCT o_custkey) FROM orders GROUP BY 2
UNION ALL SELECT 'year', date_trunc('year', o_orderdate)::DATE, count(DISTINCT o_custkey) FROM orders GROUP BY 2""")
def customers_by_period(spark, d):
    """Distinct customers of days, months and years, exactly, from one bitmap for each day."""
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("starts_on"), "o_custkey")
    days = materialize(A.distinct_bitmaps(orders, ["starts_on"], "o_custkey"), "bitmaps")
    counted = []
    for period in ("day", "month", "year"):
        coarse = A.merge_bitmaps(days.withColumn("starts_on", F.date_trunc(period, "starts_on").cast("date")), ["starts_on"])
        counted.append(A.count_bitmaps(coarse, ["starts_on"], "customers").withColumn("period", F.lit(period)))
    return J.union_by_name(counted)


@query("""SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median_price, median(CASE WHEN l_linenumber > 1 THEN l_discount END) AS median_discount FROM lineitem GROUP BY ALL
UNION ALL SELECT NULL, NULL, median(l_extendedprice), median(CASE WHEN l_linenumber > 1 THEN l_discount END) FROM lineitem""")
def exact_medians(spark, d):
    """Medians of a few large groups, and of all rows, with nulls."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("l_discount"))
    keys = ["l_returnflag", "l_linestatus"]
    of = lambda df, groups: exact_median(df, groups, "l_extendedprice", "median_price").join(exact_median(df, groups, "l_discount", "median_discount"), groups)
    every = of(lines.withColumn("one", F.lit(1)), ["one"]).drop("one")
    return of(lines, keys).unionByName(every.withColumns({k: F.lit(None).cast("string") for k in keys}))


@query(f"""WITH {_VERSIONS}, {SALES} SELECT o_orderpriority, sum(revenue)::DECIMAL(18,2) AS revenue_historical, (sum(revenue) FILTER (WHERE is_current))::DECIMAL(18,2) AS revenue_from_current_versions
FROM s JOIN v ON customer_id = o_custkey AND invoiced_at::DATE BETWEEN valid_from AND valid_to GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def then_vs_current(spark, d):
    v = versions(spark, d).withColumnRenamed("o_custkey", "customer_id")
    return K.then_vs_current(sales(spark, d), v, "customer_id", "o_orderpriority")


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + 30 AS b FROM orders), w AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i)
SELECT o_custkey, count(*) AS overlapping FROM w WHERE a <= m GROUP BY 1""")
def version_overlaps(spark, d):
    spans = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("valid_from"), F.date_add(F.to_date("o_orderdate"), 30).alias("valid_to"))
    return J.overlap_pairs(spans, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("overlapping"))


@query(f"WITH {_VERSIONS} SELECT valid_from, count(*) AS opened, count(*) FILTER (WHERE is_current) AS still_current FROM v GROUP BY 1")
def versions_opened_by_day(spark, d):
    return versions(spark, d).groupBy("valid_from").agg(F.count("*").alias("opened"), A.count_where(F.col("is_current")).alias("still_current"))


@query("""SELECT l_partkey, max_by(CASE WHEN p_size > 5 THEN p_name END, (CASE WHEN p_size > 5 THEN 1 ELSE 0 END)) AS p_name, min(l_shipdate)::DATE AS first_sold_on, max(l_shipdate)::DATE AS last_sold_on
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING max(p_size) > 5 UNION ALL
SELECT l_partkey, l_partkey::VARCHAR, min(l_shipdate)::DATE, max(l_shipdate)::DATE FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING max(p_size) <= 5""")
def scd1_parts(spark, d):
    """Small parts play products without a description."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = j.select("l_partkey", F.when(F.col("p_size") > 5, F.col("p_name")).alias("p_name"), "l_shipdate", "l_orderkey")
    return H.scd1_rebuild(lines, "l_partkey", "p_name", "l_shipdate", "l_orderkey")


@query(f"""WITH {_VERSIONS}, o AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority AS grp, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey FROM orders)
SELECT o_orderkey, o.o_custkey, 'version ' || version_number AS member FROM o JOIN v ON o.o_custkey = v.o_custkey AND o_orderdate::DATE BETWEEN valid_from AND valid_to
UNION ALL SELECT o_orderkey, NULL, 'guest ' || grp FROM o WHERE o_custkey IS NULL""")
def guest_resolution(spark, d):
    fact = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("grp"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    known = versions(spark, d).select("o_custkey", F.lit(None).cast("string").alias("grp"), F.concat(F.lit("version "), F.col("version_number").cast("string")).alias("member"), "valid_from", "valid_to")
    empty = known.where("false").withColumn("is_current", F.lit(True))
    guests = H.guest_members(empty, fact, "o_custkey", "grp").withColumn("member", F.concat(F.lit("guest "), "grp"))
    return J.resolve_member(fact, known.unionByName(guests.select(*known.columns)), "o_custkey", "o_orderdate", "grp").select("o_orderkey", "o_custkey", "member")


@query("""SELECT coalesce(n.o_custkey, t.o_custkey) AS o_custkey, coalesce(n.total, t.total) AS total FROM (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) t
FULL JOIN (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1) n ON n.o_custkey = t.o_custkey""")
def upsert_last_wins(spark, d):
    old, new = _halves(spark, d)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("total")
    return H.upsert(old.groupBy("o_custkey").agg(total), new.groupBy("o_custkey").agg(total), ["o_custkey"])


def _halves(spark, d):
    o = table(spark, d, "orders")
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut)


@query("""SELECT o_custkey, min(o_orderdate::DATE) AS first_day FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1 UNION ALL
SELECT o_custkey, min(o_orderdate::DATE) FROM orders GROUP BY 1 HAVING min(o_orderdate) >= TIMESTAMP '1996-01-01'""")
def insert_new_only(spark, d):
    old, new = _halves(spark, d)
    first = F.min(F.to_date("o_orderdate")).alias("first_day")
    return H.insert_new(old.groupBy("o_custkey").agg(first), new.groupBy("o_custkey").agg(first), ["o_custkey"])


@query("SELECT o_custkey, max(o_orderdate) AS seen_at, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def upsert_if_newer(spark, d):
    old, new = _halves(spark, d)
    last = lambda df: W.latest_per_key(df, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderdate").alias("seen_at"), "o_orderkey")
    return H.upsert_if_newer(last(new), last(old), ["o_custkey"], "seen_at")  # the late load is the older one


@query("""SELECT o_orderkey, o_orderdate::DATE AS batch_date, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def replace_batch(spark, d):
    all_ = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("batch_date"), "o_totalprice")
    batch = all_.where(F.col("batch_date") >= F.lit("1996-01-01").cast("date")).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return H.replace_batch(H.replace_batch(all_, batch, "batch_date"), batch, "batch_date")  # again: nothing changes


@query("""WITH m AS (SELECT max(o_orderdate::DATE) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderdate::DATE >= m - INTERVAL 3 DAY THEN 'new' ELSE 'old' END AS loaded FROM orders, m""")
def incremental_lookback(spark, d):
    old, _ = _halves(spark, d)
    shape = lambda df, label: df.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.lit(label).alias("loaded"))
    return H.incremental(shape(old, "old"), shape(table(spark, d, "orders"), "new"), ["o_orderkey"], "day", "3 DAYS")


@query("""SELECT o_orderdate::DATE AS day, count(*) * CASE WHEN year(o_orderdate::DATE) = 1997 THEN 1 ELSE -1 END AS n FROM orders GROUP BY 1""")
def recompute_changed(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    old = o.groupBy("day").agg((-F.count("*")).alias("n"))
    changed = o.where(F.year("day") == 1997)
    return H.recompute_changed(old, o, changed, "day", lambda df: df.groupBy("day").agg(F.count("*").alias("n")))


@query("""(SELECT o_orderkey, o_custkey, 'only_a' AS side FROM orders WHERE o_custkey % 2 = 0 AND NOT o_orderstatus = 'F') UNION ALL (SELECT o_orderkey, o_custkey, 'only_b' FROM orders WHERE o_orderstatus = 'F' AND NOT o_custkey % 2 = 0)""")
def table_diff(spark, d):
    o = table(spark, d, "orders")
    return J.diff(o.where("o_custkey % 2 = 0").select("o_orderkey", "o_custkey"), o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"))


@query("""SELECT count(*) AS lines, sum(p_size) AS sizes, sum(l_orderkey)::BIGINT AS orders FROM lineitem JOIN part ON l_partkey = p_partkey""")
def salted_join_equals_plain(spark, d):
    j = J.salted_join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey"), table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", 8)
    return j.agg(F.count("*").alias("lines"), F.sum("p_size").alias("sizes"), F.sum("l_orderkey").alias("orders"))


@query("""SELECT strftime(d, '%Y%m%d')::INT AS date_key, d::DATE AS day, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month, monthname(d) AS month_name, day(d)::INT AS day_of_month, isodow(d)::INT AS iso_weekday, dayname(d) AS day_name,
  isodow(d) >= 6 AS is_weekend FROM (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY)) AS d)""")
def calendar(spark, d):
    return H.dim_date_of(table(spark, d, "orders"), "o_orderdate")


@query("""WITH o AS (SELECT o_orderkey, month(o_orderdate)::INT AS m FROM orders), w AS (SELECT *, CASE WHEN m < lag(m) OVER (ORDER BY o_orderkey) THEN 1 ELSE 0 END AS f FROM o)
SELECT o_orderkey, m AS month_num, (2000 + sum(f) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))::INT AS year FROM w""")
def year_from_wraps(spark, d):
    from martlib.operators.clean import derive_year_from_wraps

    o = table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"))
    return derive_year_from_wraps(o, "o_orderkey", "m", 2000).select("o_orderkey", "month_num", "year")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS line_id FROM orders""")
def line_ids(spark, d):
    from martlib.operators.clean import assign_line_id

    return assign_line_id(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "line_id")


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-15' AND o_orderdate < TIMESTAMP '1995-03-16'""")
def orders_of_day(spark, d):
    return lines_for_day(table(spark, d, "orders"), "o_orderdate", "1995-03-15", ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderdate")


@query("""SELECT * FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate < (SELECT min(o_orderdate) FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '1996-06-01')
UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '1996-06-01')""")
def cut_overlap(spark, d):
    from martlib.operators.clean import cut_overlap as cut

    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    second = o.where((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderdate") >= F.lit("1996-06-01").cast("timestamp_ntz")))
    return cut(o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), second, "o_orderdate").select("o_orderkey", "o_orderdate")
