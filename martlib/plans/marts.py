"""Marts: composed queries over clean tables. Inputs are DataFrames with the columns that each docstring names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlib.functions import columns as C
from martlib.operators import aggregates as A
from martlib.operators import history as H
from martlib.operators import joins as J
from martlib.operators import windows as W

_MONEY = "decimal(18,2)"


def total(c: Column | str) -> Column:
    return F.sum(C.col(c)).cast(_MONEY)


def exact_mean(c: Column | str, scale: int = 1) -> Column:
    """The mean of numbers with few decimals: summed as decimals, so the order of rows does not matter."""
    return F.sum(C.col(c).cast(f"decimal(18,{scale})")).cast("double") / F.count(C.col(c))


# --- retail ------------------------------------------------------------------------------------------------------------


def revenue_rollup(sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Net revenue by region and quarter with subtotals by year and over all. sales: date_key, region, revenue."""
    lines = J.star_join(sales, [(dates.select("date_key", "year", "quarter"), "date_key")])
    return A.rollup_within(lines, ["year", "quarter"], ["region"], {"net_revenue": total("revenue")})


def then_vs_current(sales: DataFrame, versions: DataFrame, key: str, attribute: str, n: int = 10) -> DataFrame:
    """Revenue by the attribute as it was at each sale, and the part on versions that are current; the n greatest."""
    at_sale = J.point_in_time_join(sales, versions, key, "invoiced_at", "inner")
    out = at_sale.groupBy(attribute).agg(total("revenue").alias("revenue_historical"), A.where(F.sum, "revenue", F.col("is_current")).cast(_MONEY).alias("revenue_from_current_versions"))
    return out.orderBy(F.desc("revenue_historical"), attribute).limit(n)


def weekend_split(sales: DataFrame, dates: DataFrame) -> DataFrame:
    lines = J.star_join(sales, [(dates.select("date_key", "is_weekend"), "date_key")])
    return lines.groupBy("is_weekend").agg(F.count_distinct("invoice_no").alias("invoices"), total("revenue").alias("net_revenue"))


def invoices(lines: DataFrame) -> DataFrame:
    """One row for each invoice. lines: staged sales lines."""
    good = lines.where("NOT is_rejected AND line_type <> 'stock_adjustment'")
    return good.groupBy("invoice_no").agg(
        F.min("customer_id").alias("customer_id"), F.min("country").alias("country"), F.min("invoiced_at").alias("invoiced_at"),
        A.any_true(F.col("line_type") == "cancellation").alias("is_cancellation"), F.count("*").alias("lines"), F.sum("quantity").alias("units"), total("revenue").alias("revenue"),
    )


def dim_customers(versions: DataFrame, regions: DataFrame) -> DataFrame:
    """Versions with the region and code of their country; regions: country, region, iso_code."""
    return J.left_enrich(versions, regions, "country")


def fct_sales(lines: DataFrame, versions: DataFrame) -> DataFrame:
    """Lines that are not rejected, with the customer version valid on their day; guests have none."""
    good = lines.where("NOT is_rejected")
    v = versions.select("customer_id", F.col("version_key").alias("customer_version_key"), "valid_from", "valid_to")
    known = J.point_in_time_join(good.where("customer_id IS NOT NULL"), v, "customer_id", "invoiced_at").drop("valid_from", "valid_to")
    guests = good.where("customer_id IS NULL").withColumn("customer_version_key", F.lit(None).cast("string"))  # apart, or all would meet in one task
    return known.unionByName(guests).withColumn("date_key", C.date_key("invoice_date"))


def dim_products(lines: DataFrame) -> DataFrame:
    """One row for each stock code: its last description, whether it is a product, and its first and last day of sale."""
    good = lines.where("NOT is_rejected")
    last = H.scd1_rebuild(good, "stock_code", "product_description", "invoiced_at", "sales_line_id")
    return last.withColumns({"product_key": C.surrogate_key("stock_code"), "is_product": C.is_product("stock_code")})


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Sales, cancellations, net revenue, orders and customers by month and region, with growth on the month before that has
    sales. sales: invoiced_at, region, revenue, line_type, invoice_no, customer_id. No cancellations: null."""
    sale = F.col("line_type") == "sale"
    monthly = sales.groupBy(C.month_start("invoiced_at").alias("month"), F.coalesce("region", F.lit("Unknown")).alias("region")).agg(
        A.where(F.sum, "revenue", sale).cast(_MONEY).alias("gross_sales"), (-A.where(F.sum, "revenue", F.col("line_type") == "cancellation")).cast(_MONEY).alias("cancellations"),
        total("revenue").alias("net_revenue"), F.count_distinct(F.when(sale, F.col("invoice_no"))).alias("orders"), F.count_distinct("customer_id").alias("active_customers"),
    )
    grown = W.growth_vs_previous(monthly.withColumn("__net", F.col("net_revenue").cast("double")), ["region"], "month", "__net", "net_revenue_mom_pct")
    return grown.drop("__net")


def customer_rfm(sales: DataFrame) -> DataFrame:
    """Scores and segments of customers with positive net revenue. sales: customer_id, invoice_no, invoiced_at, revenue, line_type."""
    customers = sales.where("customer_id IS NOT NULL").groupBy("customer_id").agg(
        F.max("invoiced_at").alias("last_purchase_at"), F.count_distinct(F.when(F.col("line_type") == "sale", F.col("invoice_no"))).alias("orders"), total("revenue").alias("net_revenue"),
    ).where("net_revenue > 0")
    scored = W.percent_rank_scores(customers, {"recency_score": "last_purchase_at", "frequency_score": "orders", "monetary_score": "net_revenue"})
    return scored.withColumn("segment", C.rfm_segment("recency_score", "frequency_score", "monetary_score"))


def cohort_retention(sales: DataFrame) -> DataFrame:
    """Active customers by month of first purchase and months since. sales: customer_id, invoiced_at, line_type."""
    active = sales.where("customer_id IS NOT NULL AND line_type = 'sale'").select("customer_id", C.month_start("invoiced_at").alias("month")).distinct()
    first = F.min("month").over(Window.partitionBy("customer_id"))
    since = (F.year("month") - F.year("cohort_month")) * 12 + F.month("month") - F.month("cohort_month")
    counted = active.withColumn("cohort_month", first).groupBy("cohort_month", since.alias("months_since_first")).agg(F.count("*").alias("active_customers"))
    sized = W.first_in(counted, ["cohort_month"], "months_since_first", "active_customers", "cohort_size")
    return sized.withColumn("retention_pct", F.round(100.0 * F.col("active_customers") / F.col("cohort_size"), 1))


def top_products_by_region(sales: DataFrame, n: int) -> DataFrame:
    """Products of the n greatest ranks of each region; ties share a rank. sales: region, stock_code, revenue."""
    summed = sales.groupBy("region", "stock_code").agg(total("revenue").alias("revenue"))
    return W.rank_within(summed, ["region"], [F.desc("revenue")], "rank_in_region").where(F.col("rank_in_region") <= n)


# --- prices ------------------------------------------------------------------------------------------------------------


def symbol_report(prices: DataFrame, days: int = 365, average: int = 50) -> DataFrame:
    """Return, volatility, worst fall and position against the moving average over the days up to the last loaded one.
    prices: symbol, trade_date, adj_close."""
    last = prices.agg(F.max("trade_date").alias("__last"))
    recent = J.cross_with_scalar(prices.select("symbol", "trade_date", "adj_close"), last).where(F.datediff("__last", "trade_date") < days).drop("__last")
    part, order = ["symbol"], "trade_date"
    rich = W.daily_return(recent, part, order, "adj_close")
    rich = W.moving_average(W.running_max(rich, part, order, "adj_close", "peak"), part, order, "adj_close", average, "ma")
    return rich.groupBy("symbol").agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), A.last_by("adj_close", "trade_date").alias("last_close"),
        (100 * (A.last_by("adj_close", "trade_date") / A.first_by("adj_close", "trade_date") - 1)).alias("return_pct"),
        A.annual_volatility("daily_return").alias("volatility_pct"), (100 * F.min(F.col("adj_close") / F.col("peak") - 1)).alias("max_drawdown_pct"),
        F.max_by(F.col("adj_close") > F.col("ma"), "trade_date").alias("above_ma"),
    )


# --- trips and rides ---------------------------------------------------------------------------------------------------


def revenue_by_zone_month(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """zones: zone_id, borough, zone."""
    placed = J.star_join(trips.withColumnRenamed("pickup_zone_id", "zone_id"), [(zones, "zone_id")])
    return A.group_agg(placed, ["pickup_month", "borough", "zone"], {"trips": F.count("*"), "revenue_usd": F.round(F.sum("total_amount"), 2)})


def top_zones(trips: DataFrame, zones: DataFrame, n: int = 3) -> DataFrame:
    return W.top_n_per_group(revenue_by_zone_month(trips, zones), ["pickup_month"], "revenue_usd", n)


#: Edges of trip distances in miles, and the names of the bands.
DISTANCE_BANDS = ([1, 3, 10], ["1: under 1 mi", "2: 1-3 mi", "3: 3-10 mi", "4: 10+ mi"])


def tip_rate_by_distance(trips: DataFrame) -> DataFrame:
    """Cash tips are not recorded, so card payments alone count."""
    tip = F.round(100 * F.avg(C.ratio(F.col("tip_amount"), F.col("fare_amount"))), 1)
    return A.group_agg(trips.where("payment = 'Credit card'"), [C.band("distance_mi", *DISTANCE_BANDS).alias("distance_band")], {"trips": F.count("*"), "avg_tip_pct": tip})


def monthly_kpis(df: DataFrame, month: str, aggs: dict, growth_of: str) -> DataFrame:
    """Aggregates by month, and growth of one of them."""
    return W.growth_vs_previous(A.group_agg(df, [month], aggs), [], month, growth_of, f"{growth_of}_growth_pct")


def trips_per_day(df: DataFrame, ts: str, hour: str = "hour", day_type: str = "day_type") -> DataFrame:
    """Mean number of rows for each day, by hour and kind of day."""
    kind = F.when(C.is_weekend(ts), "weekend").otherwise("weekday")
    return df.groupBy(kind.alias(day_type), F.hour(ts).alias(hour)).agg(F.round(A.per_day_average(F.to_date(ts)), 1).alias("per_day"))


def monthly_rides(rides: DataFrame) -> DataFrame:
    return rides.groupBy("year", "month").agg(
        F.count("*").alias("rides"), C.pct(F.col("member_casual") == "member").alias("member_pct"), C.pct(F.col("rideable_type") == "electric_bike").alias("ebike_pct"),
        F.round(F.median("duration_min"), 1).alias("median_minutes"),
    )


def busiest(df: DataFrame, place: str, round_trip, n: int = 10) -> DataFrame:
    """Places with the most rows, and how many of these return to them."""
    out = df.where(F.col(place).isNotNull()).groupBy(place).agg(F.count("*").alias("rides"), C.pct(round_trip).alias("round_trip_pct"))
    return out.orderBy(F.desc("rides"), place).limit(n)


def hourly_profile(df: DataFrame, ts: str) -> DataFrame:
    kind = F.when(C.is_weekend(ts), "weekend").otherwise("weekday")
    return df.groupBy(kind.alias("day_type"), F.hour(ts).alias("hour")).agg(F.count("*").alias("rides"))


def partition_summary(rides: DataFrame, year: int, months: list[int]) -> DataFrame:
    """Reads the folders of these months only."""
    return rides.where((F.col("year") == year) & F.col("month").isin(*months)).groupBy("member_casual").agg(F.count("*").alias("rides"), F.round(F.avg("duration_min"), 1).alias("avg_minutes"))


# --- campaign ----------------------------------------------------------------------------------------------------------


def monthly_funnel(contacts: DataFrame, month: str, channel: str, converted, context: str) -> DataFrame:
    flag = C.col(converted)
    return contacts.groupBy(month, channel).agg(F.count("*").alias("calls"), A.count_where(flag).alias("conversions"), C.pct(flag).alias("conversion_pct"), F.round(F.avg(context), 3).alias(f"avg_{context}"))


def contact_fatigue(contacts: DataFrame, calls: str, converted, most: int = 10) -> DataFrame:
    """Conversion by number of calls, capped, and what one call more changes; the order is by number, not by label."""
    by_calls = contacts.groupBy(C.capped(calls, most).alias("__n")).agg(F.count("*").alias("customers"), F.avg(C.col(converted).cast("int")).alias("__rate"))
    moved = W.difference_vs_previous(by_calls, [], "__n", "__rate", "__change")
    return moved.select(C.capped_label("__n", most).alias("calls_in_campaign"), "customers", F.round(100 * F.col("__rate"), 2).alias("conversion_pct"), F.round(100 * F.col("__change"), 2).alias("change_vs_one_call_fewer_pp"))


def segment_lift(contacts: DataFrame, dimensions: dict, converted: str, least: int = 300) -> DataFrame:
    """Conversion of each segment against that of all, for segments of `least` rows or more."""
    base = contacts.agg(F.avg(F.col(converted).cast("int")).alias("overall"))
    slices = J.labelled_slices(contacts, dimensions, [converted])
    out = slices.groupBy("dimension", "segment").agg(F.count("*").alias("calls"), F.avg(F.col(converted).cast("int")).alias("rate")).where(F.col("calls") >= least)
    return J.cross_with_scalar(out, base).select("dimension", "segment", "calls", F.round(100 * F.col("rate"), 1).alias("conversion_pct"), F.round(C.ratio(F.col("rate"), F.col("overall")), 2).alias("lift"))


# --- clicks ------------------------------------------------------------------------------------------------------------


def daily_funnel(events: DataFrame, steps: dict[str, str], day: str = "event_date", session: str = "session_id") -> DataFrame:
    """Sessions of each day, and the share with each step; steps: {column: event type}."""
    return A.two_level(events, [session], [day], {n: F.col("event_type") == kind for n, kind in steps.items()}, "sessions")


def product_daily(events: DataFrame, product: str, viewed: str, bought: str, value: str, day: str = "event_date") -> DataFrame:
    """Views, purchases and revenue by product; revenue is null without a purchase."""
    is_ = lambda kind: F.col("event_type") == kind
    return events.where(F.col(product).isNotNull()).groupBy(day, product).agg(
        A.count_where(is_(viewed)).alias("views"), A.count_where(is_(bought)).alias("purchases"), F.round(A.where(F.sum, value, is_(bought)), 2).alias("revenue"),
    )


# --- stations ----------------------------------------------------------------------------------------------------------


def network_timeseries(snapshots: DataFrame) -> DataFrame:
    """snapshots: the station facts of operators.clean.station_flags."""
    on = F.col("is_operating")
    return snapshots.groupBy("taken_at").agg(
        F.sum("bikes").alias("bikes"), F.sum("ebike").alias("ebikes"), C.percent_of(F.sum("ebike"), F.sum("bikes")).alias("ebike_share_pct"),
        A.count_where(on).alias("operating_stations"), C.pct(F.when(on, F.col("is_empty"))).alias("empty_station_pct"), C.pct(F.when(on, F.col("is_full"))).alias("full_station_pct"),
    )


def area_hourly(snapshots: DataFrame, stations: DataFrame, local: str = "taken_at_local") -> DataFrame:
    joined = snapshots.where("is_operating").join(stations.select("station_id", "area", F.coalesce("arrondissement", F.lit(99)).alias("area_order")), "station_id")
    return joined.groupBy("area", "area_order", F.hour(local).alias("hour")).agg(
        F.count_distinct("snapshot_id").alias("snapshots"), F.round(exact_mean("fill_pct"), 1).alias("avg_fill_pct"), C.pct("is_empty").alias("empty_pct"),
    )


def empty_episodes(snapshots: DataFrame, key: str = "station_id", ts: str = "taken_at", flag: str = "is_empty") -> DataFrame:
    """Runs of consecutive snapshots (numbered over the whole network) in which a station is empty. snapshots: operating ones."""
    numbered = W.number_times(snapshots, ts, "__i")
    runs = W.islands_by_difference(numbered.where(flag), [key], "__i")
    seconds = F.unix_seconds(F.max(F.col(ts).cast("timestamp"))) - F.unix_seconds(F.min(F.col(ts).cast("timestamp")))
    return runs.groupBy(key, "island").agg(F.min(ts).alias("empty_from"), F.max(ts).alias("empty_until"), F.count("*").alias("snapshots"), F.round(seconds / 60).cast("int").alias("minutes_observed_empty")).drop("island")


def station_reliability(snapshots: DataFrame, stations: DataFrame) -> DataFrame:
    on = snapshots.where("is_operating")
    stats = on.groupBy("station_id").agg(
        F.count("*").alias("snapshots"), C.pct("is_empty").alias("empty_pct"), C.pct("is_full").alias("full_pct"), F.round(exact_mean("fill_pct"), 1).alias("avg_fill_pct"),
        C.percent_of(F.sum("ebike"), F.sum("bikes")).alias("ebike_share_pct"),
    )
    longest = empty_episodes(on).groupBy("station_id").agg(F.max("minutes_observed_empty").alias("longest_empty_minutes"))
    return J.left_enrich(stats.join(stations.select("station_id", "name", "area", "capacity", "lat", "lon"), "station_id"), longest, "station_id", {"longest_empty_minutes": 0})


def latest_status(snapshots: DataFrame, stations: DataFrame) -> DataFrame:
    return J.latest_only(snapshots, "taken_at").join(stations, "station_id")


def load_audit(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Runs with how many of their critical checks failed. runs: run_id, status and whatever else they hold; a run may have failed
    before its checks, or without one."""
    failed = checks.groupBy("run_id").agg(A.count_where(~F.col("passed") & (F.col("severity") == "critical")).alias("failed_checks"))
    return J.left_enrich(runs, failed, "run_id", {"failed_checks": 0})
