"""Loads, staging and sinks on the test tables: the retail feed day by day and at once, trips, rides, contacts, stations, files.

The feed is the lines with their order: every seventh customer is a guest, returned lines are cancellations, quantities are 25
less (so some are 0 or negative), and a tax above 7 % makes a price negative. The order's priority plays the country.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.functions import columns as C
from martlib.operators import clean as P
from martlib.operators import history as H
from martlib.operators import joins as J
from martlib.operators import quality as Q
from martlib.operators import windows as W
from martlib.plans import flows
from martlib.plans import marts as K
from martlib.plans.shop_queries import _VERSIONS, versions
from martlib.sources import lake, readers, writers
from martlib.sources.layout import ClusteredTable
from martlib.sources.readers import table
from martlib.sources.scratch import materialize, new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- retail feed -------------------------------------------------------------------------------------------------------


def feed(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("l_partkey")
    code = F.when(part % 10 == 0, "POST").otherwise(F.concat(F.lit("1"), F.lpad(part.cast("string"), 7, "0")))
    text = F.when(part % 10 == 0, "postage").when(part % 4 != 0, F.concat(F.lit("part "), part.cast("string"))).otherwise(" ")
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice"),
        code.alias("stock_code"), text.alias("description"), (F.col("l_quantity").cast("int") - 25).alias("quantity"), F.col("o_orderdate").cast("timestamp").alias("invoiced_at"),
        F.when(F.col("l_tax") > 0.07, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("unit_price"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("customer_id"), F.col("o_orderpriority").alias("country"),
    )


def delivered(spark: SparkSession, d: str) -> DataFrame:
    """The feed written once, for loads that read it several times: each read would join lines with orders anew."""
    return materialize(feed(spark, d), "feed")


def staged(spark: SparkSession, d: str) -> DataFrame:
    return P.stage_sales_lines(feed(spark, d).withColumn("batch_date", F.to_date("invoiced_at")))


_STAGED = """f AS (SELECT l_orderkey * 8 + l_linenumber AS line_id, CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey AS invoice_no, CASE WHEN l_partkey % 10 = 0 THEN 'POST' ELSE '1' || lpad(l_partkey::VARCHAR, 7, '0') END AS stock_code,
  CASE WHEN l_partkey % 10 = 0 THEN 'postage' WHEN l_partkey % 4 <> 0 THEN 'part ' || l_partkey END AS descr, l_quantity::INT - 25 AS quantity, o_orderdate AS invoiced_at, o_orderdate::DATE AS day, l_orderkey,
  CASE WHEN l_tax > 0.07 THEN -l_extendedprice ELSE l_extendedprice END AS price, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS customer_id, o_orderpriority AS country FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
st AS (SELECT *, round(CAST(quantity * price AS DECIMAL(18,6)), 2)::DECIMAL(18,2) AS revenue, CASE WHEN starts_with(invoice_no, 'C') THEN 'cancellation' WHEN quantity < 0 THEN 'stock_adjustment' ELSE 'sale' END AS line_type,
  quantity = 0 OR price < 0 AS is_rejected, regexp_matches(stock_code, '^[0-9]{5}') AS is_product FROM f)"""
_FED = """g AS (SELECT customer_id, day, max_by(country, l_orderkey) AS country FROM st WHERE NOT is_rejected AND customer_id IS NOT NULL GROUP BY ALL),
ch AS (SELECT *, CASE WHEN country IS DISTINCT FROM lag(country) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens FROM g WINDOW w AS (PARTITION BY customer_id ORDER BY day))"""


@query(f"""WITH {_STAGED}, {_FED}, o AS (SELECT day, sum(opens)::BIGINT AS versions_opened FROM ch GROUP BY 1)
SELECT st.day AS batch_date, count(*) AS lines, sum(revenue)::DECIMAL(18,2) AS revenue, count(*) FILTER (WHERE customer_id IS NULL) AS guest_lines, coalesce(max(versions_opened), 0)::BIGINT AS versions_opened
FROM st LEFT JOIN o ON st.day = o.day WHERE NOT is_rejected GROUP BY 1""")
def daily_loader(spark, d):
    """All days at once, and then the last two days again as daily batches: they replace themselves and change nothing."""
    loader, lines = flows.DailyLoader(spark, new_folder(spark, "shop")), delivered(spark, d)
    loader.rebuild(lines)
    last = [str(r["day"]) for r in readers.trading_days(lines, "invoiced_at").orderBy(F.desc("day")).limit(2).collect()][::-1]
    loader.backfill(lines, last)
    facts = loader.facts().groupBy("batch_date").agg(F.count("*").alias("lines"), K.total("revenue").alias("revenue"), F.count(F.when(F.col("customer_id").isNull(), 1)).alias("guest_lines"))
    opened = loader.customers().where("customer_id IS NOT NULL").groupBy(F.col("valid_from").alias("batch_date")).agg(F.count("*").alias("versions_opened"))
    return J.left_enrich(facts, opened, "batch_date", {"versions_opened": 0})


def _numbered_days(lines: DataFrame) -> list[str]:
    return [str(r["day"]) for r in readers.trading_days(lines, "invoiced_at").orderBy("day").collect()]  # a row for each day


@query(f"""WITH {_STAGED}, n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM st)),
a AS (SELECT day AS batch_date, count(*) AS raw, count(*) FILTER (WHERE NOT is_rejected) AS facts, count(*) FILTER (WHERE is_rejected) AS rejected, 0::BIGINT AS failed_checks, 'loaded' AS status, false AS has_error FROM st GROUP BY day)
SELECT * FROM a UNION ALL SELECT DATE '2031-01-01', 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT, 'failed', true UNION ALL SELECT DATE '2031-01-02', 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT, 'failed', true""")
def load_audit(spark, d):
    """What the loader wrote down of its runs, by day: all days in two runs, a day without lines (which must not be empty), and a
    run whose lines are of another day than it names."""
    loader, lines = flows.DailyLoader(spark, new_folder(spark, "audited")), delivered(spark, d)
    days = _numbered_days(lines)
    loader.backfill(lines, days, at_once=1 + len(days) // 2)
    for named, some in (("2031-01-01", lines.where(F.lit(False))), ("2031-01-02", readers.lines_for_day(lines, "invoiced_at", days[0], ["line_id"]))):
        try:
            loader.run_batch(some, named)
        except Q.ChecksFailed:
            continue
        raise AssertionError(f"{named} was loaded")
    return K.load_audit(loader.audit(), loader.checks()).select("batch_date", "raw", "facts", "rejected", "failed_checks", "status", F.col("error").isNotNull().alias("has_error"))


@query(f"""WITH {_STAGED}, n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM st)), taken AS (SELECT day FROM n WHERE i % 2 = 0 OR i % 6 = 1),
lc AS (SELECT customer_id, day, max_by(country, line_id) AS country FROM st JOIN taken USING (day) WHERE NOT is_rejected AND customer_id IS NOT NULL GROUP BY ALL),
ch AS (SELECT *, CASE WHEN country IS DISTINCT FROM lag(country) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens FROM lc WINDOW w AS (PARTITION BY customer_id ORDER BY day)),
v AS (SELECT customer_id, country, day AS valid_from FROM ch WHERE opens = 1), t AS (SELECT *, lead(valid_from) OVER (PARTITION BY customer_id ORDER BY valid_from) AS next FROM v),
u AS (SELECT customer_id, country, valid_from, coalesce(next - 1, DATE '9999-12-31')::DATE AS valid_to, next IS NULL AS is_current FROM t),
s AS (SELECT customer_id, valid_from, count(*) AS lines, sum(revenue)::DECIMAL(18,2) AS revenue FROM st JOIN taken USING (day) JOIN u USING (customer_id) WHERE NOT is_rejected AND day BETWEEN valid_from AND valid_to GROUP BY ALL)
SELECT u.*, s.lines, s.revenue FROM u JOIN s USING (customer_id, valid_from)""")
def late_days(spark, d):
    """Every second day is loaded, then every third of the others, backwards in two runs, and the first run's last days again: the
    history, and the sales of each version, are those of all these days together."""
    loader, lines = flows.DailyLoader(spark, new_folder(spark, "late")), delivered(spark, d)
    days = _numbered_days(lines)
    even, late = days[::2], days[1::6][::-1]
    loader.backfill(lines, even, at_once=len(even))
    loader.backfill(lines, late, at_once=1 + len(late) // 2)
    loader.backfill(lines, even[-3:], at_once=3)
    sales = loader.sales().where("customer_id IS NOT NULL").groupBy("customer_id", "valid_from").agg(F.count("*").alias("lines"), K.total("revenue").alias("revenue"))
    return loader.customers().where("customer_id IS NOT NULL").join(sales, ["customer_id", "valid_from"])


@query(f"""WITH {_STAGED} SELECT line_type, is_product, customer_id IS NULL AS is_guest, is_rejected, count(*) AS lines, count(descr) AS described, sum(quantity)::BIGINT AS units, sum(revenue)::DECIMAL(18,2) AS revenue FROM st GROUP BY ALL""")
def staged_lines(spark, d):
    return staged(spark, d).groupBy("line_type", "is_product", "is_guest", "is_rejected").agg(F.count("*").alias("lines"), F.count("product_description").alias("described"), F.sum("quantity").alias("units"), K.total("revenue").alias("revenue"))


@query(f"""WITH {_VERSIONS} SELECT o_custkey AS customer_id, version_number, o_orderpriority AS country, valid_from, valid_to, is_current, md5(o_custkey || '-' || version_number) AS version_key,
  CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'region ' || left(o_orderpriority, 1) END AS region, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN upper(right(o_orderpriority, 2)) END AS iso_code FROM v""")
def dim_customers(spark, d):
    """One country has no region."""
    v = versions(spark, d).withColumnsRenamed({"o_custkey": "customer_id", "o_orderpriority": "country"})
    country = F.col("country")
    regions = table(spark, d, "orders").select(F.col("o_orderpriority").alias("country")).distinct().where(country != "3-MEDIUM")
    return K.dim_customers(v, regions.select(country, F.concat(F.lit("region "), F.left(country, F.lit(1))).alias("region"), F.upper(F.right(country, F.lit(2))).alias("iso_code")))


@query(f"""WITH {_STAGED} SELECT stock_code, coalesce(max(descr), stock_code) AS product_description, min(day) AS first_sold_on, max(day) AS last_sold_on, md5(stock_code) AS product_key, any_value(is_product) AS is_product FROM st WHERE NOT is_rejected GROUP BY stock_code""")
def dim_products(spark, d):
    return K.dim_products(staged(spark, d))


@query(f"""WITH {_STAGED}, {_VERSIONS} SELECT line_id AS sales_line_id, invoice_no, stock_code, revenue, strftime(day, '%Y%m%d')::INT AS date_key, CASE WHEN customer_id IS NOT NULL THEN md5(o_custkey || '-' || version_number) END AS customer_version_key
FROM st LEFT JOIN v ON customer_id = o_custkey AND day BETWEEN valid_from AND valid_to WHERE NOT is_rejected""")
def fct_sales(spark, d):
    v = versions(spark, d).withColumnRenamed("o_custkey", "customer_id")
    return K.fct_sales(staged(spark, d), v).select("sales_line_id", "invoice_no", "stock_code", "revenue", "date_key", "customer_version_key")


@query(f"WITH {_VERSIONS} SELECT o_custkey, version_number, o_orderpriority, valid_from, valid_to FROM v WHERE o_custkey = 7 AND DATE '1998-07-01' BETWEEN valid_from AND valid_to")
def version_of_one_customer(spark, d):
    return J.version_on(versions(spark, d), "o_custkey", 7, "1998-07-01").select("o_custkey", "version_number", "o_orderpriority", "valid_from", "valid_to")


# --- merges ------------------------------------------------------------------------------------------------------------


def _last(spark, d, until: str | None = None) -> DataFrame:
    o = table(spark, d, "orders")
    o = o if until is None else o.where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
    return W.latest_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority")


_LAST = "SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders"


@query(f"""WITH a AS ({_LAST} WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS ({_LAST} GROUP BY 1)
SELECT o_custkey, a.p AS o_orderpriority, DATE '1997-01-01' AS valid_from, CASE WHEN a.p = b.p THEN DATE '9999-12-31' ELSE DATE '2001-12-30' END AS valid_to, a.p = b.p AS is_current FROM a JOIN b USING (o_custkey)
UNION ALL SELECT o_custkey, b.p, DATE '2001-12-31', DATE '9999-12-31', true FROM b LEFT JOIN a USING (o_custkey) WHERE a.p IS DISTINCT FROM b.p""")
def snapshot_check(spark, d):
    """What two looks at the customers tell: one in 1997, one at the end of 2001."""
    first = _last(spark, d, "1997-01-01").withColumns({"valid_from": F.lit("1997-01-01").cast("date"), "valid_to": F.lit(C.OPEN_END).cast("date"), "is_current": F.lit(True)})
    return flows.snapshot_check(first, _last(spark, d), "o_custkey", ["o_orderpriority"], "2001-12-31")


@query(f"""WITH a AS ({_LAST} WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS ({_LAST} GROUP BY 1) SELECT o_custkey, b.p AS o_orderpriority FROM a JOIN b USING (o_custkey) WHERE a.p <> b.p""")
def changed_priorities(spark, d):
    return J.change_join(_last(spark, d, "1997-01-01"), _last(spark, d), "o_custkey", ["o_orderpriority"])


@query("""WITH n AS (SELECT DISTINCT p_partkey, CASE WHEN p_size > 5 THEN p_name END AS new_name FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT p_partkey, 'old ' || p_name AS old_name FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(new_name, old_name) AS p_name FROM n FULL JOIN o USING (p_partkey)""")
def scd1_upsert_parts(spark, d):
    """Small parts bring no description, and keep the one they have."""
    part = table(spark, d, "part")
    dim = part.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("old "), "p_name").alias("p_name"))
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_name")).alias("p_name"), "l_shipdate")
    return H.scd1_upsert(dim, lines, "p_partkey", "p_name", [F.desc("l_shipdate")])


_VERSIONED = """t0 AS (SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1),
b1 AS (SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
t1 AS (SELECT o_custkey, coalesce(b1.p, t0.p) AS p FROM t0 FULL JOIN b1 USING (o_custkey) WHERE b1.p IS DISTINCT FROM '5-LOW'),
b2 AS (SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1),
t2 AS (SELECT o_custkey, coalesce(b2.p, t1.p) AS p FROM t1 FULL JOIN b2 USING (o_custkey) WHERE b2.p IS DISTINCT FROM '5-LOW')"""


def _merged_versions(spark, d) -> tuple[DataFrame, DataFrame, writers.ChangeLog]:
    """Customers' last priority before 1995, after 1997 came in, and after the rest did; a customer whose last order of a load has
    a low priority is deleted. Returns the first and the last table, and the log of both merges."""
    o, cut = table(spark, d, "orders"), [F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1997-01-01")]
    at = F.col("o_orderdate")
    first, one, two = (W.latest_per_key(o.where(t), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority") for t in (at < cut[0], (at >= cut[0]) & (at < cut[1]), at >= cut[1]))
    log, now = writers.ChangeLog(spark, f"{new_folder(spark, 'changes')}/log"), first
    for version, batch in ((1, one), (2, two)):
        log.write(version, H.merge_with_changes(now, batch, ["o_custkey"], F.col("o_orderpriority") == "5-LOW"))
        now = H.apply_changes(now, log.read(version - 1, version), ["o_custkey"])
    return first, now, log


@query(f"WITH {_VERSIONED} SELECT o_custkey, p AS o_orderpriority FROM t2")
def merged_by_changes(spark, d):
    """The first table and the net changes of two merges give the last table."""
    first, _, log = _merged_versions(spark, d)
    return H.apply_changes(first, H.net_changes(log.read(0, 2), ["o_custkey"]), ["o_custkey"])


@query(f"""WITH {_VERSIONED}, f AS (SELECT 1 AS version, o_custkey, a.p AS was, b.p AS now FROM t0 a FULL JOIN t1 b USING (o_custkey) UNION ALL SELECT 2, o_custkey, a.p, b.p FROM t1 a FULL JOIN t2 b USING (o_custkey)),
k AS (SELECT version, unnest(CASE WHEN was IS NULL THEN ['insert'] WHEN now IS NULL THEN ['delete'] WHEN was <> now THEN ['update_before', 'update_after'] ELSE [] END) AS change FROM f)
SELECT version::INT AS version, change, count(*) AS rows FROM k GROUP BY ALL""")
def changes_by_version(spark, d):
    return _merged_versions(spark, d)[2].read(0, 2).groupBy("version", "change").agg(F.count("*").alias("rows"))


_MISSING = "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)"


def _missing(spark, d) -> tuple[DataFrame, DataFrame]:
    dim = table(spark, d, "part").where("p_size <= 40").select("p_partkey")
    return dim, H.missing_members(dim, table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query(_MISSING)
def missing_members(spark, d):
    return _missing(spark, d)[1]


@query(f"""SELECT p_partkey, (SELECT max(p_partkey) FROM part WHERE p_size <= 40) + row_number() OVER (ORDER BY p_partkey) AS part_id FROM ({_MISSING})""")
def surrogate_numbers(spark, d):
    dim, new = _missing(spark, d)
    return H.assign_surrogate_keys(dim.withColumnRenamed("p_partkey", "part_id"), new, "part_id", ["p_partkey"])


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderpriority END AS o_orderpriority FROM orders""")
def evolved_schema(spark, d):
    """Later orders come with one column more."""
    o, cut = table(spark, d, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    return H.evolve_schema(o.where(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey"), o.where(F.col("o_orderdate") >= cut).select("o_orderkey", "o_custkey", "o_orderpriority"))


@query("SELECT o_orderkey, o_orderdate FROM orders")
def empty_template(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return J.union_by_name([flows.empty_like(o), o])


# --- joins and windows -------------------------------------------------------------------------------------------------


@query("SELECT p_brand, count(*) AS lines, sum(l_quantity) AS units FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def broadcast_parts(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return J.broadcast_join(table(spark, d, "lineitem"), part, "l_partkey").groupBy("p_brand").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("units"))


@query("SELECT o_orderstatus, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def merge_joined_orders(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return J.merge_join(table(spark, d, "lineitem"), orders, "l_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("lines"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def parts_without_large_lines(spark, d):
    large = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return J.anti_join(table(spark, d, "part"), large, "p_partkey").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def orders_in_debt(spark, d):
    debtors = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi_join(table(spark, d, "orders"), debtors, "o_custkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, day, recency::INT AS recency FROM (SELECT o_custkey, day, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC) AS recency FROM (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders)) WHERE recency <= 3")
def recent_order_days(spark, d):
    days = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    return W.recency_number(days, ["o_custkey"], "day").where("recency <= 3")


# --- trips and rides ---------------------------------------------------------------------------------------------------


def _trips(spark, d) -> DataFrame:
    """Lines as trips: of 5 minutes for each piece less 10, and a quarter of a mile for each piece less one."""
    start = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 3600
    end = start + F.col("l_quantity").cast("bigint") * 300 - 600
    raw = table(spark, d, "lineitem").select(
        F.timestamp_seconds(start).alias("tpep_pickup_datetime"), F.timestamp_seconds(end).alias("Tpep_Dropoff_Datetime"), F.col("l_linenumber").alias("passenger_count"),
        ((F.col("l_quantity") - 1) / 4).alias("trip_distance"), F.col("l_suppkey").alias("PULocationID"), (F.col("l_partkey") % 100).alias("DOLocationID"), (F.col("l_linenumber") % 5).cast("string").alias("payment_type"),
        (F.col("l_extendedprice") - 5000).alias("fare_amount"), (F.col("l_discount") * 1000).alias("tip_amount"), F.lit("0").alias("tolls_amount"), F.col("l_extendedprice").alias("total_amount"),
    )
    return P.quality_verdict(P.unify(raw, P.TRIP_COLUMNS), P.trip_rules("1996-01-01", "2001-01-01"))


_TRIPS = """r AS (SELECT l_shipdate + to_hours(l_linenumber) AS t, l_quantity * 5 - 10 AS minutes, (l_quantity - 1) / 4 AS miles, l_suppkey AS zone_id, l_linenumber % 5 AS pay, l_extendedprice - 5000 AS fare, l_discount * 1000 AS tip, l_extendedprice AS total FROM lineitem),
q AS (SELECT *, CASE WHEN t < TIMESTAMP '1996-01-01' OR t >= TIMESTAMP '2001-01-01' THEN 'pickup outside period' WHEN minutes <= 0 THEN 'dropoff not after pickup' WHEN minutes > 180 THEN 'longer than 3 hours'
  WHEN NOT (miles > 0 AND miles <= 100) THEN 'distance not in (0, 100] miles' WHEN fare <= 0 OR total <= 0 THEN 'non-positive fare' ELSE 'ok' END AS quality FROM r)"""


@query(f"WITH {_TRIPS} SELECT quality, count(*) AS trips FROM q GROUP BY 1")
def trip_verdicts(spark, d):
    return _trips(spark, d).groupBy("quality").agg(F.count("*").alias("trips"))


@query(f"""WITH {_TRIPS}, g AS (SELECT strftime(t, '%Y-%m') AS pickup_month, s_nationkey::VARCHAR AS borough, s_name AS zone, count(*) AS trips, round(sum(total), 2) AS revenue_usd FROM q JOIN supplier ON zone_id = s_suppkey WHERE quality = 'ok' GROUP BY ALL)
SELECT pickup_month, borough, zone, trips, revenue_usd, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pickup_month ORDER BY revenue_usd DESC, borough, zone, trips) AS rank FROM g) WHERE rank <= 3""")
def top_zones(spark, d):
    zones = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("zone_id"), F.col("s_nationkey").cast("string").alias("borough"), F.col("s_name").alias("zone"))
    return K.top_zones(P.to_clean_trips(_trips(spark, d)), zones)


@query(f"""WITH {_TRIPS} SELECT CASE WHEN miles < 1 THEN '1: under 1 mi' WHEN miles < 3 THEN '2: 1-3 mi' WHEN miles < 10 THEN '3: 3-10 mi' ELSE '4: 10+ mi' END AS distance_band, count(*) AS trips, round(100 * avg(tip / nullif(fare, 0)), 1) AS avg_tip_pct
FROM q WHERE quality = 'ok' AND pay = 1 GROUP BY 1""")
def tip_rates(spark, d):
    return K.tip_rate_by_distance(P.to_clean_trips(_trips(spark, d)))


def _rides(spark, d) -> DataFrame:
    """Events as rides of as many minutes as their value, less half a minute; ids are shared by three, and some have none. Of rides
    with one id, start and end the first event counts."""
    e = table(spark, d, "events")
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    raw = e.select(
        F.when(F.col("event_id") % 50 != 0, F.col("event_id") - F.col("event_id") % 3).alias("ride_id"), start.alias("started_at"), F.timestamp_seconds(F.unix_seconds(start) + (F.col("value") * 60).cast("bigint") - 30).alias("ended_at"),
        F.when(F.col("user_id") % 2 == 0, "member").otherwise("casual").alias("member_casual"), F.when(F.col("event_type") == "click", "electric_bike").otherwise("classic_bike").alias("rideable_type"),
        "event_id",
    )
    return P.clean_rides(raw, ties=("event_id",)).drop("event_id")


_RIDES = """r AS (SELECT CASE WHEN event_id % 50 <> 0 THEN event_id - event_id % 3 END AS ride_id, date_trunc('second', ts) AS a, date_trunc('second', ts) + to_seconds(trunc(value * 60)::BIGINT - 30) AS b, CASE WHEN user_id % 2 = 0 THEN 'member' ELSE 'casual' END AS member_casual, event_type FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY ride_id, date_trunc('month', a) ORDER BY a, b) AS n FROM r WHERE ride_id IS NOT NULL AND b > a AND date_diff('minute', a, b) <= 1440),
c AS (SELECT year(a)::INT AS year, month(a)::INT AS month, member_casual, event_type, round(date_diff('second', a, b) / 60, 2) AS duration_min FROM k WHERE n = 1)"""


@query(f"""WITH {_RIDES} SELECT year, month, count(*) AS rides, round(100 * avg((member_casual = 'member')::INT), 1) AS member_pct, round(100 * avg((event_type = 'click')::INT), 1) AS ebike_pct, round(median(duration_min), 1) AS median_minutes FROM c GROUP BY ALL""")
def monthly_rides(spark, d):
    return K.monthly_rides(_rides(spark, d))


@query(f"WITH {_RIDES} SELECT member_casual, count(*) AS rides, round(avg(duration_min), 1) AS avg_minutes FROM c WHERE year = 2024 AND month IN (1, 2) GROUP BY 1")
def ride_partitions(spark, d):
    """Written by year and month, in order within each file; the summary reads the folders that it names."""
    path = new_folder(spark, "rides")
    writers.sorted_partition_write(_rides(spark, d), path, ["year", "month"], ["started_at"])
    return K.partition_summary(spark.read.parquet(path), 2024, [1, 2])


# --- contacts ----------------------------------------------------------------------------------------------------------


def contacts(spark, d) -> DataFrame:
    """Customers as contacts in the order of their number, fifty a month; every thirteenth has an unknown month."""
    k = F.col("c_custkey")
    month = F.element_at(F.array(*[F.lit(m) for m in C.MONTHS]), (F.floor(k / 50) % 12 + 1).cast("int"))
    raw = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 13 == 0, "xxx").otherwise(month).alias("month"), (15 + k % 60).cast("int").alias("age"), F.when(k % 5 == 0, 999).otherwise((k % 30).cast("int")).alias("pdays"), (k % 4).cast("int").alias("campaign"),
        F.when(F.col("c_mktsegment") == "BUILDING", "yes").when(F.col("c_mktsegment") == "MACHINERY", "maybe").otherwise("no").alias("y"), F.lit(60).alias("duration"),
    )
    return P.derive_year_from_wraps(raw, "c_custkey", "month", 2008)


_CONTACTS = """c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey // 50) % 12 + 1 END AS m, (15 + c_custkey % 60)::INT AS age, CASE WHEN c_custkey % 5 = 0 THEN 999 ELSE c_custkey % 30 END AS pdays, c_custkey % 4 AS campaign,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'yes' WHEN 'MACHINERY' THEN 'maybe' ELSE 'no' END AS y FROM customer), w AS (SELECT *, CASE WHEN m < lag(m) OVER (ORDER BY k) THEN 1 ELSE 0 END AS f FROM c),
x AS (SELECT *, CASE WHEN m IS NOT NULL THEN make_date(2008 + sum(f) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT, m::BIGINT, 1::BIGINT) END AS contact_month FROM w)"""


@query(f"""WITH {_CONTACTS} SELECT CASE WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' ELSE '65+' END AS age_band, pdays <> 999 AS previously_contacted, strftime(contact_month, '%Y-%m') AS partition_month,
  count(*) AS calls, count(*) FILTER (WHERE y = 'yes') AS conversions, sum(nullif(pdays, 999))::BIGINT AS days FROM x GROUP BY ALL""")
def contact_features(spark, d):
    f = P.stage_contacts(P.campaign_features(contacts(spark, d)))
    return f.groupBy("age_band", "previously_contacted", "partition_month").agg(F.count("*").alias("calls"), F.count(F.when(F.col("converted"), 1)).alias("conversions"), F.sum("days_since_previous").alias("days"))


# --- columns -----------------------------------------------------------------------------------------------------------


@query(f"""WITH n AS (SELECT n_nationkey, ['United Kingdom', 'France', 'EIRE', 'Japan', 'USA'][(n_nationkey % 5 + 1)::INT] AS country FROM nation)
SELECT n_nationkey AS n_key, country, CASE WHEN country = 'United Kingdom' THEN country WHEN country IN ({", ".join(repr(c) for c in C.EUROPE)}) THEN 'Europe' ELSE 'Rest of world' END AS region, 'same' AS sql_function FROM n""")
def regions_of_nations(spark, d):
    """The expression and the SQL function, on columns whose names are cleaned first."""
    C.register_functions(spark)
    country = F.element_at(F.array(*[F.lit(c) for c in ("United Kingdom", "France", "EIRE", "Japan", "USA")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    n = P.snake_case_columns(table(spark, d, "nation").select(F.col("n_nationkey").alias("N.KEY"), country.alias("Country")))
    return n.select("n_key", "country", C.region_of("country").alias("region"), F.when(F.expr("region_of(country)") == C.region_of("country"), "same").otherwise("other").alias("sql_function"))


@query("SELECT o_orderkey, strftime(o_orderdate::DATE + to_hours((o_orderkey % 24)::BIGINT), '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def serial_timestamps(spark, d):
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")) + (F.col("o_orderkey") % 24) / 24
    return table(spark, d, "orders").select("o_orderkey", F.date_format(C.serial_to_timestamp(serial), "yyyy-MM-dd HH:mm:ss").alias("at"))


# --- files -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS o_totalprice FROM orders UNION ALL SELECT l_orderkey, l_extendedprice::DECIMAL(18,2) FROM lineitem")
def unified_files(spark, d):
    """Two files whose names and types of columns disagree, as one."""
    path = new_folder(spark, "unify")
    table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("O_OrderKey"), F.col("o_totalprice").cast("string").alias("O_TOTALPRICE")).write.parquet(f"{path}/a")
    table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice")).write.parquet(f"{path}/b")
    return readers.read_unified(spark, [f"{path}/a", f"{path}/b"], {"o_orderkey": "bigint", "o_totalprice": "decimal(18,2)"})


@query("""SELECT 'typed' AS reader, s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT 'strings', s_suppkey, CASE WHEN s_nationkey <> 3 THEN s_name END, s_nationkey FROM supplier UNION ALL SELECT 'seed', s_suppkey, s_name, s_nationkey FROM supplier""")
def csv_round_trip(spark, d):
    """The suppliers as one CSV file, read with types, as text that is cast, and as a seed; blank names become null."""
    path, schema = new_folder(spark, "csv"), "s_suppkey bigint, s_name string, s_nationkey int"
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    writers.save_result_csv(s, f"{path}/a")
    writers.save_result_csv(s.withColumn("s_name", F.when(F.col("s_nationkey") == 3, " ").otherwise(F.col("s_name"))), f"{path}/b")
    found = {"typed": readers.read_csv_typed(spark, f"{path}/a", schema), "strings": readers.read_csv_strings(spark, f"{path}/b", s.columns, {"s_suppkey": "bigint", "s_nationkey": "int"}), "seed": readers.read_seed(spark, f"{path}/a", schema)}
    return J.union_by_name([df.withColumn("reader", F.lit(n)) for n, df in found.items()])


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS total, 1::BIGINT AS files FROM orders GROUP BY 1")
def partition_writers(spark, d):
    """One file for each year, written twice over, then sorted, then compacted; a second load replaces the first."""
    path = new_folder(spark, "orders")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    writers.force_compute(o)
    writers.full_reload(o.where("year < 1996"), f"{path}/t")
    writers.full_reload(o, f"{path}/t")
    writers.one_file_per_partition(spark.read.parquet(f"{path}/t"), f"{path}/y", "year")
    writers.sorted_partition_write(spark.read.parquet(f"{path}/t"), f"{path}/y", ["year"], ["o_orderkey"])
    writers.compact_partitions(spark, f"{path}/y", ["year"], "o_orderkey", 1)
    got = spark.read.parquet(f"{path}/y").withColumn("file", F.col("_metadata.file_path"))
    return got.groupBy("year").agg(F.count("*").alias("orders"), K.total(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count_distinct("file").alias("files"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS landed, count(*) AS lines FROM orders GROUP BY 1")
def bronze_appends(spark, d):
    path = new_folder(spark, "bronze")
    o = table(spark, d, "orders").select("o_orderkey", C.month_start("o_orderdate").alias("_landing_date"))
    for half in (o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")):
        writers.append_bronze(half.coalesce(1), f"{path}/t")
    return spark.read.parquet(f"{path}/t").groupBy(F.col("_landing_date").alias("landed")).agg(F.count("*").alias("lines"))


@query("""WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS delivered FROM orders)
SELECT period, max('raw/' || period || '/delivered=' || delivered || '.csv') AS path, max(delivered) AS delivered FROM p GROUP BY 1""")
def latest_deliveries(spark, d):
    """Each order date stands for a delivery of its month, forty days later."""
    month, day = F.date_format("o_orderdate", "yyyy-MM"), F.date_format(F.date_add(F.to_date("o_orderdate"), 40), "yyyy-MM-dd")
    files = table(spark, d, "orders").select(F.concat(F.lit("raw/"), month, F.lit("/delivered="), day, F.lit(".csv")).alias("path"))
    return readers.latest_delivery(files, r"raw/(\d{4}-\d{2})/", r"delivered=(\d{4}-\d{2}-\d{2})")


_LAKE = "region nation customer supplier part orders lineitem events".split()


_COLUMNS = """SELECT {name} AS "table", column_name AS "column", CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type,
  {is_partition} AS is_partition, {partitions}::INT AS partitions FROM information_schema.columns WHERE table_name IN ({tables})"""


@query(
    _COLUMNS.format(name="table_name", is_partition="false", partitions="0", tables=", ".join(f"'{t}'" for t in _LAKE))
    + " UNION ALL "
    + _COLUMNS.format(name="'by_status'", is_partition="column_name = 'o_orderstatus'", partitions="(SELECT count(DISTINCT o_orderstatus) FROM orders)", tables="'orders'")
)
def lake_inventory(spark, d):
    """The tables become views by their names, and so does a partitioned one; what is in them, column by column."""
    root = new_folder(spark, "lake")
    writers.one_file_per_partition(table(spark, d, "orders"), f"{root}/by_status", "o_orderstatus")
    return lake.register_lake(spark, d).where(F.col("table").isin(_LAKE)).unionByName(lake.register_lake(spark, root))


@query("""SELECT l_returnflag, count(*) AS lines, sum(l_quantity) AS units, true AS few_files FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-08-31' AND l_partkey BETWEEN 20 AND (SELECT max(l_partkey) // 4 FROM lineitem) GROUP BY 1""")
def clustered_lookup(spark, d):
    """Lines laid out by day and part: a range of both reads a third of the files at most, and one of either half of them."""
    lines = table(spark, d, "lineitem").withColumn("shipped", F.col("l_shipdate").cast("timestamp"))
    most = lines.agg(F.max("l_partkey")).first()[0] // 4
    t = ClusteredTable(spark, new_folder(spark, "clustered"), ["shipped", "l_partkey"])
    t.write(lines, 32)
    days, parts = {"shipped": (datetime(1995, 3, 1), datetime(1995, 8, 31))}, {"l_partkey": (20, most)}
    shares = [len(files) / n for files, n in (t.picked(r) for r in (days | parts, days, parts))]
    found = t.read(days | parts).groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("units"))
    return found.withColumn("few_files", F.lit(shares[0] <= 1 / 3 and max(shares[1:]) <= 1 / 2))


@query("""SELECT * FROM (VALUES (1, 5, (SELECT count(*) FROM region)), (2, 0, 0), (3, 1, (SELECT count(*) FROM nation))) t(run, files, lines)""")
def ingested_by_content(spark, d):
    """Regions in five files, one of them delivered twice; then copies under other names; then a file with a changed content."""
    root = new_folder(spark, "ledger")
    put = lambda df, folder: df.write.mode("append").text(f"{root}/in/{folder}")
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("value"))
    for k in range(5):
        put(regions.where(F.col("k") == k).select("value").coalesce(1), f"first{k}")
    put(regions.where("k = 3").select("value").coalesce(1), "again")
    done = [flows.ingest_by_content(spark, f"{root}/in", f"{root}/lake")]
    put(regions.where("k = 1").select("value").coalesce(1), "renamed")
    done.append(flows.ingest_by_content(spark, f"{root}/in", f"{root}/lake"))
    put(table(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("value")).coalesce(1), "first0")
    done.append(flows.ingest_by_content(spark, f"{root}/in", f"{root}/lake"))
    return spark.createDataFrame([(i + 1, r["files"], r["lines"]) for i, r in enumerate(done)], "run int, files int, lines long")


@query("SELECT 'by_region' AS name, r_name AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'by_status', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus")
def named_queries(spark, d):
    lake.register_lake(spark, d)
    text = """-- name: by_region
SELECT r_name AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name;
-- name: by_status
SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY o_orderstatus;
"""
    return J.union_by_name([df.withColumn("name", F.lit(n)) for n, df in readers.run_named_queries(spark, text).items()])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def served_orders(spark, d):
    return lake.serve(table(spark, d, "orders"), "o_orderstatus = 'O'", [F.desc("o_totalprice"), "o_orderkey"], 15).select("o_orderkey", "o_totalprice")


@query("""SELECT p_brand AS symbol, l_shipdate::DATE AS trade_date, min(l_extendedprice)::DECIMAL(14,4) AS open, max(l_extendedprice)::DECIMAL(14,4) AS high, min(l_extendedprice)::DECIMAL(14,4) AS low, max(l_extendedprice)::DECIMAL(14,4) AS close,
  max(l_extendedprice)::DECIMAL(14,4) AS adj_close, sum(l_quantity)::BIGINT AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def price_bars(spark, d):
    """The prices of each brand as one chart document, and back to bars."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    day = j.groupBy("p_brand", F.to_date("l_shipdate").alias("day")).agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.sum("l_quantity").cast("bigint").alias("volume"))
    bars = day.groupBy(F.col("p_brand").alias("symbol")).agg(F.array_sort(F.collect_list(F.struct((F.unix_date("day") * F.lit(86400).cast("bigint")).alias("ts"), "least", "most", "volume"))).alias("b"))
    quote = F.struct(F.col("b.least").alias("open"), F.col("b.most").alias("high"), F.col("b.least").alias("low"), F.col("b.most").alias("close"), F.col("b.volume").alias("volume"))
    result = F.struct(F.struct(F.lit("UTC").alias("exchangeTimezoneName")).alias("meta"), F.col("b.ts").alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.lit(None).cast("array<struct<adjclose:array<double>>>").alias("adjclose")).alias("indicators"))
    return readers.explode_price_bars(bars.select("symbol", F.struct(F.lit(None).cast("string").alias("error"), F.array(result).alias("result")).alias("chart")))
