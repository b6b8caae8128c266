"""Queries on the events table: clicks as sessions, errors as empty stations, and the same events as a stream.

A session is a user's day; steps are view, click and purchase; 'error' plays an empty or broken state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.functions import columns as C
from martlib.operators import clean as P
from martlib.operators import windows as W
from martlib.operators.history import add_counts, count_delta, new_rows
from martlib.plans import marts as K
from martlib.sources.readers import table
from martlib.sources.scratch import new_folder
from martlib.streaming import clicks

_PROPS = T.StructType([T.StructField("k", T.LongType())])
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    product = F.get_json_object("props", "$.k")
    return e.withColumns({"event_date": F.to_date("ts"), "session_id": F.concat_ws("-", "user_id", F.to_date("ts").cast("string")), "product_id": product})


@query("""WITH s AS (SELECT ts::DATE AS event_date, user_id, max((event_type = 'view')::INT) AS viewed, max((event_type = 'click')::INT) AS clicked, max((event_type = 'purchase')::INT) AS bought FROM events GROUP BY ALL)
SELECT event_date, count(*) AS sessions, round(100 * avg(viewed), 2) AS viewed, round(100 * avg(clicked), 2) AS clicked, round(100 * avg(bought), 2) AS bought FROM s GROUP BY 1""")
def daily_funnel(spark, d):
    return K.daily_funnel(events(spark, d), {"viewed": "view", "clicked": "click", "bought": "purchase"})


@query("""SELECT ts::DATE AS event_date, props->>'$.k' AS product_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  round(sum(value::DECIMAL(18,6)) FILTER (WHERE event_type = 'purchase'), 2)::DECIMAL(18,2) AS revenue FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY ALL""")
def product_daily(spark, d):
    e = events(spark, d).withColumn("v", F.col("value").cast("decimal(18,6)"))
    return K.product_daily(e, "product_id", "view", "purchase", "v").withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))


@query("""SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS events FROM events GROUP BY ALL""")
def json_props(spark, d):
    parsed = P.parse_json(table(spark, d, "events"), _PROPS, "props")
    return parsed.groupBy("event_type", F.col("e.k").alias("k")).agg(F.count("*").alias("events"))


@query("""SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, hour(ts)::INT AS hour, count(*) AS rides FROM events GROUP BY ALL""")
def hourly_profile(spark, d):
    return K.hourly_profile(table(spark, d, "events"), "ts")


@query("""SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, hour(ts)::INT AS hour, round(count(*) / count(DISTINCT ts::DATE), 1) AS per_day FROM events GROUP BY ALL""")
def per_day_average(spark, d):
    return K.trips_per_day(table(spark, d, "events"), "ts")


@query("""WITH m AS (SELECT ts::DATE AS day, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1)
SELECT *, round(100 * (events::DOUBLE / nullif(lag(events) OVER (ORDER BY day), 0) - 1), 1) AS events_growth_pct FROM m""")
def daily_kpis(spark, d):
    e = events(spark, d)
    aggs = {"events": F.count("*"), "users": F.count_distinct("user_id"), "purchases": F.count(F.when(F.col("event_type") == "purchase", 1))}
    return K.monthly_kpis(e.withColumnRenamed("event_date", "day"), "day", aggs, "events")


@query("""SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS calls, count(*) FILTER (WHERE value > 50) AS conversions, round(100 * avg((value > 50)::INT), 1) AS conversion_pct, round(avg(value::DECIMAL(18,6))::DOUBLE, 3) AS avg_v FROM events GROUP BY ALL""")
def daily_channel_funnel(spark, d):
    e = events(spark, d).withColumns({"day": F.to_date("ts"), "v": F.col("value").cast("decimal(18,6)")})
    out = K.monthly_funnel(e, "day", "event_type", F.col("value") > 50, "v")
    return out.withColumn("avg_v", F.col("avg_v").cast("double"))


@query("""WITH u AS (SELECT user_id, count(*) AS calls, max((event_type = 'purchase')::INT) AS converted FROM events GROUP BY 1), g AS (SELECT least(calls, 10) AS n, count(*) AS customers, avg(converted) AS rate FROM u GROUP BY 1)
SELECT CASE WHEN n >= 10 THEN '10+' ELSE n::VARCHAR END AS calls_in_campaign, customers, round(100 * rate, 2) AS conversion_pct, round(100 * (rate - lag(rate) OVER (ORDER BY n)), 2) AS change_vs_one_call_fewer_pp FROM g""")
def contact_fatigue(spark, d):
    users = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.bool_or(F.col("event_type") == "purchase").alias("converted"))
    return K.contact_fatigue(users, "calls", "converted")


# --- stations: a station is user_id modulo 40, a snapshot is an hour; it is empty if it had an error in that hour ---------------


def station_hours(spark, d):
    e = events(spark, d)
    g = e.groupBy((F.col("user_id") % 40).alias("station_id"), F.date_trunc("hour", "ts").alias("taken_at")).agg(
        F.count("*").alias("bikes"), F.count(F.when(F.col("event_type") == "click", 1)).alias("ebike"), F.bool_or(F.col("event_type") == "error").alias("is_empty"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("docks"))
    full = F.col("docks") == 0
    return g.withColumns({"is_operating": F.lit(True), "is_full": full, "snapshot_id": F.date_format("taken_at", "yyyyMMddHH"), "taken_at_local": F.col("taken_at"), "fill_pct": C.percent_of(F.col("bikes"), F.col("bikes") + F.col("docks"))})


def stations(spark, d):
    ids = table(spark, d, "events").select((F.col("user_id") % 40).alias("station_id")).distinct()
    coded = ids.withColumns({"station_code": F.concat(((F.col("station_id") + 1) * 1000 + 7).cast("string")), "name": F.concat(F.lit("s"), F.col("station_id").cast("string")), "capacity": F.lit(30), "lat": F.lit(48.0), "lon": F.lit(2.0)})
    return P.stage_stations(coded)


_HOURS = """h AS (SELECT user_id % 40 AS station_id, date_trunc('hour', ts) AS taken_at, count(*) AS bikes, count(*) FILTER (WHERE event_type = 'click') AS ebike, bool_or(event_type = 'error') AS is_empty, count(*) FILTER (WHERE event_type = 'purchase') AS docks FROM events GROUP BY ALL),
f AS (SELECT *, docks = 0 AS is_full, round(100 * bikes / nullif(bikes + docks, 0), 1) AS fill_pct FROM h)"""
_AREA = "CASE WHEN station_id = 0 THEN '1er' WHEN station_id < 20 THEN (station_id + 1)::VARCHAR || 'e' ELSE 'Suburbs' END"
_EPISODES = """n AS (SELECT *, dense_rank() OVER (ORDER BY taken_at) AS i FROM f), e AS (SELECT *, i - row_number() OVER (PARTITION BY station_id ORDER BY i) AS g FROM n WHERE is_empty),
x AS (SELECT station_id, min(taken_at) AS empty_from, max(taken_at) AS empty_until, count(*) AS snapshots, (date_diff('minute', min(taken_at), max(taken_at)))::INT AS minutes_observed_empty FROM e GROUP BY station_id, g)"""


@query(f"WITH {_HOURS}, {_EPISODES} SELECT * FROM x")
def error_episodes(spark, d):
    return K.empty_episodes(station_hours(spark, d))


@query(f"""WITH {_HOURS}, {_EPISODES}, l AS (SELECT station_id, max(minutes_observed_empty) AS m FROM x GROUP BY 1)
SELECT f.station_id, {_AREA.replace('station_id', 'f.station_id')} AS area, count(*) AS snapshots, round(100 * avg(is_empty::INT), 1) AS empty_pct, round(100 * avg(is_full::INT), 1) AS full_pct, round(100 * sum(ebike) / nullif(sum(bikes), 0), 1) AS ebike_share_pct,
  round(sum(fill_pct::DECIMAL(18,1))::DOUBLE / count(fill_pct), 1) AS avg_fill_pct, coalesce(max(m), 0) AS longest_empty_minutes, 's' || f.station_id AS name, 30 AS capacity, 48.0::DOUBLE AS lat, 2.0::DOUBLE AS lon
  FROM f LEFT JOIN l ON f.station_id = l.station_id GROUP BY 1, 2""")
def reliability(spark, d):
    return K.station_reliability(station_hours(spark, d), stations(spark, d))


@query(f"""WITH {_HOURS} SELECT {_AREA} AS area, CASE WHEN station_id < 20 THEN station_id + 1 ELSE 99 END::INT AS area_order, hour(taken_at)::INT AS hour, count(DISTINCT taken_at) AS snapshots, round(100 * avg(is_empty::INT), 1) AS empty_pct,
  round(sum(fill_pct::DECIMAL(18,1))::DOUBLE / count(fill_pct), 1) AS avg_fill_pct FROM f GROUP BY ALL""")
def area_hour(spark, d):
    return K.area_hourly(station_hours(spark, d), stations(spark, d))


@query(f"""WITH {_HOURS} SELECT taken_at, sum(bikes)::BIGINT AS bikes, sum(ebike)::BIGINT AS ebikes, round(100 * sum(ebike) / nullif(sum(bikes), 0), 1) AS ebike_share_pct, count(*) AS operating_stations, round(100 * avg(is_empty::INT), 1) AS empty_station_pct,
  round(100 * avg(is_full::INT), 1) AS full_station_pct FROM f GROUP BY 1""")
def network_timeseries(spark, d):
    return K.network_timeseries(station_hours(spark, d))


@query(f"WITH {_HOURS} SELECT station_id, {_AREA} AS area, taken_at, bikes, docks, is_empty FROM f WHERE taken_at = (SELECT max(taken_at) FROM f)")
def latest_status(spark, d):
    return K.latest_status(station_hours(spark, d), stations(spark, d)).select("station_id", "area", "taken_at", "bikes", "docks", "is_empty")


@query("""SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1""")
def user_spans(spark, d):
    spans = W.span_of(table(spark, d, "events"), ["user_id"], "ts", ("first_seen", "last_seen"))
    return spans.groupBy("user_id", "first_seen", "last_seen").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("""SELECT user_id, max(c) AS longest_run FROM (SELECT user_id, event_type, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id, event_type, g) GROUP BY 1""")
def longest_runs(spark, d):
    runs = W.islands_by_change(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "run")
    return runs.groupBy("user_id", "run").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.max("c").alias("longest_run"))


# --- streams: the file source reads the events file; availableNow takes what is there -----------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)


def _folder(spark: SparkSession) -> str:
    """A new folder for a stream's tables and checkpoint, below the folder that all machines share."""
    return new_folder(spark, "stream")


def _run(spark: SparkSession, stream: DataFrame, write) -> None:
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{_folder(spark)}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


@query("""SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS events, round(sum(CASE WHEN event_type = 'purchase' THEN value::DECIMAL(18,6) END), 2)::DECIMAL(18,2) AS revenue FROM events GROUP BY ALL""")
def minute_counts_stream(spark, d):
    """Each batch's counts are kept under its id; every batch is written twice here, as a replay would, and counts once."""
    root = _folder(spark)
    from martlib.sources.writers import overwrite_partitions

    def write(batch, batch_id):
        e = batch.withColumn("minute", F.date_trunc("minute", "ts"))
        delta = count_delta(e, batch_id, ["minute", "event_type"], {"events": F.count("*"), "revenue": F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,6)")))})
        for _ in range(2):
            overwrite_partitions(delta, f"{root}/counts", ["batch_id"])

    _run(spark, _stream(spark, d), write)
    out = add_counts(spark.read.parquet(f"{root}/counts"), ["minute", "event_type"], ["events", "revenue"])
    return out.withColumn("revenue", F.round("revenue", 2).cast("decimal(18,2)"))


@query("SELECT event_id, user_id, event_type FROM events")
def dedupe_stream(spark, d):
    """The stream is delivered twice over; each event is kept once."""
    root = _folder(spark)
    from martlib.sources.writers import overwrite_partitions

    def write(batch, batch_id):
        twice = batch.select("event_id", "user_id", "event_type").union(batch.select("event_id", "user_id", "event_type"))
        seen = spark.read.parquet(f"{root}/events").where(F.col("batch_id") != batch_id) if state["any"] else twice.limit(0)
        overwrite_partitions(new_rows(seen, twice, ["event_id"]).withColumn("batch_id", F.lit(batch_id)), f"{root}/events", ["batch_id"])
        state["any"] = True

    state = {"any": False}
    for _ in range(2):
        _run(spark, _stream(spark, d), lambda b, i, k=_: write(b, 2 * i + k))
    return spark.read.parquet(f"{root}/events").drop("batch_id")


@query("""SELECT reason, count(*) AS events FROM (SELECT CASE WHEN event_type = 'error' THEN 'unknown event_type' WHEN event_type <> 'signup' AND (props->>'$.k')::BIGINT >= 90 THEN 'unknown product' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY 1""")
def quarantine_stream(spark, d):
    """Events as JSON text through the stream's validator; what it rejects is kept with its reason, once for each batch."""
    root = _folder(spark)
    from martlib.sources.writers import quarantine

    kinds = {"view": "product_view", "click": "add_to_cart", "purchase": "purchase", "signup": "page_view"}
    text = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"), F.col("user_id").cast("string").alias("user_id"), F.lit("s").alias("session_id"),
        C.lookup_map("event_type", kinds, "error").alias("event_type"), F.lit("/").alias("page"), F.get_json_object("props", "$.k").alias("product_id"), F.col("value").alias("price")))
    products = [str(i) for i in range(90)]

    def write(batch, batch_id):
        tagged = clicks.validate(batch.select(text.alias("value")), products)
        for _ in range(2):
            quarantine(tagged.where("reject_reason IS NOT NULL").select("value", "reject_reason"), f"{root}/bad", str(batch_id))

    _run(spark, _stream(spark, d), write)
    return spark.read.parquet(f"{root}/bad").groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("events"))
