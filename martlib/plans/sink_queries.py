"""Stations, medallion, click sinks and checks on the test tables. A station is user_id modulo 40, a click event an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlib.functions import columns as C
from martlib.operators import aggregates as A
from martlib.operators import clean as P
from martlib.operators import joins as J
from martlib.operators import quality as Q
from martlib.plans import flows
from martlib.plans.event_queries import _HOURS, _run, _stream, station_hours
from martlib.plans.load_queries import _CONTACTS, contacts
from martlib.sources import lake, readers, writers
from martlib.sources.readers import table
from martlib.sources.scratch import new_folder
from martlib.streaming import clicks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- stations ----------------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A document for each day, taken at eleven in Paris: what each station has, as counts of the day's events."""
    taken = F.to_utc_timestamp(F.col("date").cast("timestamp") + F.expr("INTERVAL 11 HOURS"), "Europe/Paris")
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1)).cast("int")
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), (F.col("user_id") % 40).alias("station_id")).agg(n("view").alias("m"), n("click").alias("e"), n("purchase").alias("docks"), n("error").alias("errors"))
    code = ((F.col("station_id") + 1) * 1000 + 7).cast("string").alias("stationCode")
    kinds = F.array(F.struct(F.col("m").alias("mechanical"), F.lit(None).cast("int").alias("ebike")), F.struct(F.lit(None).cast("int").alias("mechanical"), F.col("e").alias("ebike")))
    status = F.struct("station_id", code, kinds.alias("num_bikes_available_types"), F.col("docks").alias("num_docks_available"), F.when(F.col("station_id") == 39, 0).otherwise(1).alias("is_installed"), F.when(F.col("errors") == 0, 1).otherwise(0).alias("is_renting"), F.lit(1).alias("is_returning"))
    info = F.struct("station_id", code, F.concat(F.lit("s"), F.col("station_id").cast("string")).alias("name"), F.lit(48.5).alias("lat"), F.lit(2.5).alias("lon"), F.dayofmonth("date").alias("capacity"))
    days = e.groupBy("date").agg(F.collect_list(status).alias("s"), F.collect_list(info).alias("i"))  # 40 stations at most
    of = lambda c: F.struct(F.struct(F.col(c).alias("stations")).alias("data"))
    return days.select("date", F.date_format("date", "yyyyMMdd").alias("snapshot_id"), F.date_format(taken, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("taken_at"), of("i").alias("information"), of("s").alias("status"))


def _loaded_stations(spark: SparkSession, d: str) -> str:
    """The documents as gzipped files, loaded in two deliveries of which the second repeats the first; the folder."""
    root = new_folder(spark, "stations")
    _snapshots(spark, d).write.option("compression", "gzip").option("maxRecordsPerFile", 1).partitionBy("date").json(f"{root}/lake")
    docs = readers.read_gz_snapshots(spark, f"{root}/lake")
    flows.load_snapshot(spark, root, docs.where("snapshot_id >= '20240110'"))
    flows.load_snapshot(spark, root, docs)
    return root


_DAYS = """h AS (SELECT ts::DATE AS day, user_id % 40 AS station_id, count(*) FILTER (WHERE event_type = 'view') AS m, count(*) FILTER (WHERE event_type = 'click') AS e, count(*) FILTER (WHERE event_type = 'purchase') AS docks, count(*) FILTER (WHERE event_type = 'error') = 0 AS renting FROM events GROUP BY ALL)"""


@query(f"""WITH {_DAYS} SELECT day, station_id, (m + e)::INT AS bikes, docks::INT AS docks, round(100 * (m + e) / nullif(m + e + docks, 0), 1) AS fill_pct, renting AND m + e = 0 AS is_empty, docks = 0 AS is_full, renting AS is_operating, 11 AS local_hour FROM h WHERE station_id <> 39""")
def station_snapshots(spark, d):
    """The station fact: from documents through load, staging and flags."""
    root = _loaded_stations(spark, d)
    status = P.station_flags(P.stage_station_status(spark.read.parquet(f"{root}/status")))
    return status.select("day", "station_id", "bikes", "docks", "fill_pct", "is_empty", "is_full", "is_operating", F.hour("taken_at_local").alias("local_hour"))


@query(f"""WITH {_DAYS}, l AS (SELECT station_id, max(day) AS last FROM h GROUP BY 1) SELECT station_id, ((station_id + 1) * 1000 + 7)::VARCHAR AS station_code, 's' || station_id AS name, day(last)::INT AS capacity, CASE WHEN station_id < 20 THEN station_id + 1 END::INT AS arrondissement,
  CASE WHEN station_id = 0 THEN '1er' WHEN station_id < 20 THEN (station_id + 1)::VARCHAR || 'e' ELSE 'Suburbs' END AS area FROM l""")
def stations_last_seen(spark, d):
    return P.stage_stations(flows.read_stations(spark, _loaded_stations(spark, d))).select("station_id", "station_code", "name", "capacity", "arrondissement", "area")


@query(f"""WITH {_HOURS} SELECT 'first ' || (station_id // 20)::VARCHAR AS area, {", ".join(f'(avg(is_empty::INT) FILTER (WHERE hour(taken_at) = {h}) > 0)::INT AS "{h}"' for h in range(24))} FROM f GROUP BY 1""")
def area_grid(spark, d):
    hours = station_hours(spark, d).groupBy(F.concat(F.lit("first "), F.floor(F.col("station_id") / 20).cast("string")).alias("area"), F.hour("taken_at").alias("hour")).agg((F.avg(F.col("is_empty").cast("int")) > 0).cast("int").alias("empty"))
    return lake.area_hour_grid(hours, "empty")


# --- medallion ---------------------------------------------------------------------------------------------------------

_KINDS = {"view": "product_view", "click": "add_to_cart", "purchase": "purchase", "signup": "page_view"}


def click_text(device: bool = False) -> F.Column:
    """An event as the JSON text of a click; errors have an unknown type. device: every second user sends one field more."""
    fields = [
        F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"), F.col("user_id").cast("string").alias("user_id"), F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("session_id"),
        C.lookup_map("event_type", _KINDS, "error").alias("event_type"), F.lit("/").alias("page"), F.get_json_object("props", "$.k").alias("product_id"), F.col("value").alias("price"),
    ]
    return F.to_json(F.struct(*fields, *([F.when(F.col("user_id") % 2 == 0, "phone").alias("device")] if device else [])))


@query("""WITH e AS (SELECT ts::DATE AS event_date, user_id, event_type FROM events), s AS (SELECT event_date, user_id, max((event_type = 'view')::INT) AS v, max((event_type = 'click')::INT) AS c, max((event_type = 'purchase')::INT) AS p FROM e WHERE event_type <> 'error' GROUP BY ALL),
f AS (SELECT event_date, count(*) AS sessions, round(100 * avg(v), 2) AS product_view_pct, round(100 * avg(c), 2) AS cart_pct, round(100 * avg(p), 2) AS purchase_pct FROM s GROUP BY 1)
SELECT f.*, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS views, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchases, count(*) FILTER (WHERE event_type = 'error') AS rejected FROM f JOIN e USING (event_date) GROUP BY ALL""")
def medallion(spark, d):
    """Events as text files by landing date, to bronze, silver and gold; a second run finds nothing to do."""
    root = new_folder(spark, "medallion")
    lines = table(spark, d, "events").select(click_text(device=True).alias("value"), F.to_date("ts").alias("landed"))
    lines.repartition("landed").write.partitionBy("landed").text(f"{root}/landing")
    m = flows.Medallion(spark, f"{root}/lake")
    m.run(f"{root}/landing")
    m.run(f"{root}/landing")
    of = lambda name: spark.read.parquet(f"{root}/lake/{name}")
    products = of("product_daily").groupBy("event_date").agg(F.sum("views").alias("views"), F.sum("purchases").alias("purchases"))
    rejected = of("quarantine").groupBy(F.col("_landing_date").alias("event_date")).agg(F.count("*").alias("rejected"))
    return J.left_enrich(of("daily_funnel").join(products, "event_date"), rejected, "event_date", {"rejected": 0})


@query("""SELECT event_id::VARCHAR AS event_id, CASE WHEN user_id % 2 = 0 THEN 'phone' END AS device, user_id % 7 AS place_x, CASE WHEN user_id % 3 = 0 THEN 'k' || user_id END AS place_tag,
  CASE WHEN day(ts) <= 15 THEN (user_id % 5)::VARCHAR ELSE 'level ' || (user_id % 5) END AS level, CASE WHEN day(ts) <= 15 THEN user_id::DOUBLE ELSE (user_id % 9 + 0.25)::DOUBLE END AS score,
  concat(user_id % 3, ',', user_id % 4) AS steps, 'device string, level variant, place struct<tag:string,x:bigint>, score decimal(21,2), steps array<bigint>' AS kinds FROM events WHERE event_type <> 'error'""")
def event_fields(spark, d):
    """Events whose added fields are nested or change their types between two loads, as columns in the types that hold both."""
    root = new_folder(spark, "fields")
    early, u = F.dayofmonth("ts") <= 15, F.col("user_id")
    place = F.struct((u % 7).alias("x"), F.when(u % 3 == 0, F.concat(F.lit("k"), u)).alias("tag"))
    number = lambda c: F.when(early, c)
    more = {"place": place, "steps": F.array(u % 3, u % 4), "level": number(u % 5), "score": number(u)}
    late = {"level": F.when(~early, F.concat(F.lit("level "), u % 5)), "score": F.when(~early, (u % 9 + F.lit(0.25).cast("double")))}
    events = table(spark, d, "events").withColumn("text", click_text(device=True))
    join = lambda fields: F.concat(F.expr("left(text, length(text) - 1)"), F.lit(","), F.substring(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])), 2, 1 << 30))
    m = flows.Medallion(spark, f"{root}/lake")
    for name, part in (("a", events.where(early).select(join(more))), ("b", events.where(~early).select(join(more | late)))):
        part.write.text(f"{root}/landing/{name}")
        m.bronze(f"{root}/landing/*")
        m.silver()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.fields().fields)
    return m.events().select("event_id", "device", F.col("place.x").alias("place_x"), F.col("place.tag").alias("place_tag"), "level", F.col("score").cast("double").alias("score"), F.concat_ws(",", F.col("steps").cast("array<string>")).alias("steps"), F.lit(kinds).alias("kinds"))


# --- click sink --------------------------------------------------------------------------------------------------------

_PRODUCTS = [str(i) for i in range(90)]
_VALID = "event_type <> 'error' AND (event_type = 'signup' OR (props->>'$.k')::BIGINT < 90)"


def _sink(spark: SparkSession, d: str) -> clicks.ClickSink:
    """The stream of events through the validator into the sink, and the same events again as a second batch."""
    root = new_folder(spark, "clicks")
    sink = clicks.ClickSink(spark, f"{root}/sink")
    sink.start(_stream(spark, d).select(click_text().alias("value")), _PRODUCTS, f"{root}/checkpoint").awaitTermination()
    sink.write_batch(clicks.validate(table(spark, d, "events").select(click_text().alias("value")), _PRODUCTS), 1000)
    return sink


@query(f"""SELECT date_trunc('minute', ts) AS minute, CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'page_view' ELSE event_type END AS event_type, count(*) AS events,
  round(sum(CASE WHEN event_type = 'purchase' THEN value END), 2)::DECIMAL(18,2) AS revenue FROM events WHERE {_VALID} GROUP BY ALL""")
def click_minutes(spark, d):
    return _sink(spark, d).minute_counts().withColumns({"minute": F.col("minute").cast("timestamp_ntz"), "revenue": F.round("revenue", 2).cast("decimal(18,2)")})


@query(f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_VALID}) AS k FROM events) SELECT false AS again, n AS received, n - k AS invalid, k AS inserted, 0::BIGINT AS duplicates FROM n UNION ALL SELECT true, n, n - k, 0, k FROM n""")
def click_stats(spark, d):
    return _sink(spark, d).stats().groupBy((F.col("batch_id") >= 1000).alias("again")).agg(*[F.sum(c).alias(c) for c in ("received", "invalid", "inserted", "duplicates")])


@query("""SELECT event_type, count(*) AS events FROM events GROUP BY 1""")
def deduplicated_within(spark, d):
    """Every event comes twice; repeats within the watermark go."""
    path = new_folder(spark, "late")
    twice = _stream(spark, d).select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    _run(spark, clicks.dedupe_within(twice, "event_id", "ts", "2 days"), lambda batch, i: writers.overwrite_partitions(batch.withColumn("batch_id", F.lit(i)), f"{path}/t", ["batch_id"]))
    return spark.read.parquet(f"{path}/t").groupBy("event_type").agg(F.count("*").alias("events"))


@query("""WITH e AS (SELECT *, event_id % 4 AS file FROM events), m AS (SELECT file, max(ts) AS top FROM e GROUP BY 1),
w AS (SELECT e.*, (SELECT max(top) FROM m WHERE m.file < e.file - 1) AS seen FROM e), k AS (SELECT *, seen IS NOT NULL AND ts <= date_trunc('milliseconds', seen) - INTERVAL 10 DAY AS late FROM w)
SELECT CASE WHEN late THEN 'too late' ELSE event_type END AS event_type, count(*) AS events FROM k GROUP BY 1""")
def late_events(spark, d):
    """Four files of events, a batch each. A batch leaves out what is ten days older than the newest event up to the last batch but
    one, because it uses the watermark that the batch before it began with; kept and late events are counted."""
    root = new_folder(spark, "lateness")
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_type")
    for k in range(4):  # files are taken in the order in which they were written
        events.where(F.col("event_id").cast("long") % 4 == k).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{root}/in/part{k}")
    lines = clicks.read_clicks_stream(spark, {"path": f"{root}/in", "files_at_once": 1})
    parsed = lines.select(F.from_json("value", "event_id string, ts timestamp, event_type string").alias("e")).select("e.*")
    put = lambda batch, i: writers.overwrite_partitions(batch.withColumn("batch_id", F.lit(i)), f"{root}/kept", ["batch_id"])
    query = clicks.dedupe_within(parsed, "event_id", "ts", "10 days").writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.parquet(f"{root}/kept").groupBy("event_type").agg(F.count("*").alias("events"))
    return kept.unionByName(spark.createDataFrame([("too late", clicks.too_late(query))], "event_type string, events long"))


@query("SELECT user_id, count(*) AS events, true AS in_order FROM events GROUP BY 1")
def user_order(spark, d):
    """Each user's events lie together in one partition, in order of time; each row is held against the one before it."""
    dealt = clicks.in_user_order(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    before = F.lag("ts").over(Window.partitionBy("user_id", "part").orderBy("at"))
    checked = dealt.withColumn("in_order", F.coalesce(before <= F.col("ts"), F.lit(True)))
    return checked.groupBy("user_id").agg(F.count("*").alias("events"), (F.bool_and("in_order") & (F.count_distinct("part") == 1)).alias("in_order"))


# --- checks ------------------------------------------------------------------------------------------------------------


def _rows(checks: list[tuple], source: str) -> str:
    """SQL for rows of checks: (name, severity, observed, passed)."""
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, '{s}' AS severity, ({o})::DOUBLE AS observed, {p.replace('observed', f'({o})')} AS passed {source}" for n, s, o, p in checks)


def _bad(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


_WEATHER = "FROM (SELECT l_suppkey AS city, l_shipdate::DATE AS date, l_quantity * 3 - 40 AS a, l_quantity + 12 AS b, l_tax - 0.01 AS p, l_discount AS w FROM lineitem)"


@query(_rows([("least is not above greatest", "critical", _bad("a > b"), "observed = 0"), ("temperatures within 60 degrees", "critical", _bad("abs(a) > 60 OR abs(b) > 60"), "observed = 0"), ("nothing negative", "critical", _bad("p < 0 OR w < 0"), "observed = 0"),
              ("one row for a city and day", "critical", "count(*) - count(DISTINCT (city, date))", "observed = 0")], _WEATHER))
def weather_checks(spark, d):
    """Lines as weather: suppliers are cities, quantities temperatures."""
    q = F.col("l_quantity")
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("city"), F.to_date("l_shipdate").alias("date"), (q * 3 - 40).alias("temp_min"), (q + 12).alias("temp_max"), (F.col("l_tax") - 0.01).alias("precipitation"), F.col("l_discount").alias("wind_speed"))
    return Q.run_checks(w, Q.weather_checks())


_OHLC = "SELECT p_brand AS symbol, l_shipdate::DATE AS trade_date, min(l_extendedprice) AS open, max(l_extendedprice) - 50000 AS high, min(l_extendedprice) AS low, max(l_extendedprice) AS close, sum(l_quantity)::BIGINT - 30 AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"
_MOVES = f"FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS move FROM ({_OHLC}))"


@query(_rows([("positive prices", "critical", _bad("NOT least(open, high, low, close) > 0"), "observed = 0"), ("open and close within the day''s range", "critical", _bad("NOT (low <= least(open, close) AND greatest(open, close) <= high)"), "observed = 0"), ("volume is not negative", "critical", _bad("volume < 0"), "observed = 0"),
              ("no future trading day", "critical", _bad("trade_date > DATE '2001-06-01'"), "observed = 0"), ("no weekend trading day", "critical", _bad("isodow(trade_date) >= 6"), "observed = 0"), ("daily move within bounds", "critical", _bad("abs(move) > 0.5"), "observed = 0")], _MOVES))
def price_checks(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    price = F.col("l_extendedprice")
    bars = j.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("trade_date")).agg(F.min(price).alias("open"), (F.max(price) - 50000).alias("high"), F.min(price).alias("low"), F.max(price).alias("close"), (F.sum("l_quantity").cast("bigint") - 30).alias("volume"))
    return Q.run_checks(bars, Q.price_checks()).unionByName(Q.price_table_checks(bars, "2001-06-01"))


@query(_rows([("enough rows", "critical", "count(*)", "observed >= 1000"), ("few unknown references", "critical", f"{_bad('p_partkey IS NULL')} / count(*)", "observed <= 0.05")], "FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON l_partkey = p_partkey"))
def feed_checks(spark, d):
    return Q.feed_completeness(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), table(spark, d, "part").where("p_size <= 40"), "p_partkey", 1000)


_AGE = "(epoch(TIMESTAMP '2003-01-01') - epoch(max(o_orderdate))) / 3600"


@query(_rows([("o_orderdate within 24 h", "warn", _AGE, "observed <= 24"), ("o_orderdate within 20000 h", "critical", _AGE, "observed <= 20000")], "FROM orders"))
def freshness(spark, d):
    return Q.run_checks(table(spark, d, "orders"), Q.fresh("o_orderdate", "2003-01-01 00:00:00", 24, 20000))


_RECENT = "FROM (SELECT taken_at, count(*) AS n, sum(bikes) AS bikes FROM f WHERE taken_at > TIMESTAMP '2024-01-30 23:30:00' - INTERVAL 24 HOUR GROUP BY 1)"


@query(f"WITH {_HOURS} " + _rows([("smallest snapshot of a day", "critical", "min(n)", "observed >= 5"), ("not frozen", "critical", "count(DISTINCT CASE WHEN taken_at > TIMESTAMP '2024-01-30 23:30:00' - INTERVAL 1 HOUR THEN bikes END)", "observed > 1")], _RECENT)
       + " UNION ALL " + _rows([("within capacity", "warn", _bad("bikes + docks > 4"), "observed = 0")], "FROM f"))
def monitoring(spark, d):
    hours = station_hours(spark, d)
    places = hours.select("station_id").distinct().withColumn("capacity", F.lit(2))
    return Q.monitoring_checks(hours, "taken_at", "2024-01-30 23:30:00", 5).unionByName(Q.over_capacity(hours, places, "station_id"))


@query(_rows([("finished_pct in range", "critical", _bad("pct < 0 OR pct > 100"), "observed = 0"), ("mostly finished", "warn", _bad("pct < 90"), "observed = 0")], "FROM (SELECT 100 * avg((o_orderstatus = 'F')::INT) AS pct FROM orders GROUP BY o_custkey)"))
def contract_checks(spark, d):
    """The table has the columns agreed upon; a warning that fails does not stop the load."""
    o = Q.enforce_contract(table(spark, d, "orders"), "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    by = o.groupBy("o_custkey").agg(C.pct(F.col("o_orderstatus") == "F", 6).alias("finished_pct"))
    return Q.require(Q.run_checks(by, [Q.in_range("finished_pct", 0, 100), Q.holds("mostly finished", F.col("finished_pct") >= 90, severity="warn")]))


@query(f"""WITH {_CONTACTS} SELECT 'month name not recognized' AS rule, count(*) FILTER (WHERE m IS NULL) AS violations FROM x UNION ALL SELECT 'age outside 17-100', count(*) FILTER (WHERE age NOT BETWEEN 17 AND 100) FROM x
UNION ALL SELECT 'campaign contacts < 1', count(*) FILTER (WHERE campaign < 1) FROM x UNION ALL SELECT 'outcome not yes/no', count(*) FILTER (WHERE y NOT IN ('yes', 'no')) FROM x
UNION ALL SELECT 'contact month outside May 2008 - Nov 2010', count(*) FILTER (WHERE contact_month IS NULL OR contact_month NOT BETWEEN DATE '2008-05-01' AND DATE '2010-11-01') FROM x""")
def campaign_rule_counts(spark, d):
    return A.rule_counts(contacts(spark, d), Q.campaign_rules())


@query(_rows([("few urgent orders", "critical", _bad("o_orderpriority = '1-URGENT'"), "observed = 0"), ("small totals", "warn", _bad("o_totalprice > 400000"), "observed = 0")], "FROM orders"))
def alerts(spark, d):
    """What failed is written once for each run; the run is written twice here."""
    path = new_folder(spark, "alerts")
    checks = Q.run_checks(table(spark, d, "orders"), [
        Q.Check("few urgent orders", Q.offending(F.col("o_orderpriority") == "1-URGENT")), Q.holds("small totals", F.col("o_totalprice") <= 400000, severity="warn"), Q.not_null("o_orderkey"),
    ])
    for _ in range(2):
        writers.write_alerts(checks, f"{path}/t", "run")
    return spark.read.parquet(f"{path}/t").drop("run_id")
