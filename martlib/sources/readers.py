"""Readers. Schemas are declared; nothing is inferred but partition columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.functions import columns as C
from martlib.operators.clean import unify
from martlib.operators.joins import union_by_name


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_unified(spark: SparkSession, paths: list[str], schema: dict[str, str]) -> DataFrame:
    """Files whose column case and types disagree, each cast to one schema."""
    return union_by_name([unify(spark.read.parquet(p), schema) for p in paths])


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str], casts: dict[str, str], sep: str = ",") -> DataFrame:
    """All columns as text, then cast; what cannot be cast is null and empty text is null."""
    raw = spark.read.csv(path, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]), sep=sep, header=True)
    return raw.select(*[C.blank_to_null(c).try_cast(casts[c]).alias(c) if c in casts else C.blank_to_null(c).alias(c) for c in columns])


def read_lines_with_lineage(spark: SparkSession, path: str, stream: bool = False, files_at_once: int | None = None) -> DataFrame:
    """Lines of text with their file, the time of reading, and the landing date in the file's path; empty lines go.
    files_at_once: of a stream, how many files a batch takes, oldest first."""
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", "true")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("_source_file"))
    day = F.try_to_timestamp(F.nullif(F.regexp_extract("_source_file", r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).cast("date")
    return lines.where(F.trim("value") != "").withColumns({"_ingested_at": F.current_timestamp(), "_landing_date": day})


def explode_parallel_arrays(df: DataFrame, arrays: dict[str, Column | str]) -> DataFrame:
    """One row for each position of arrays of equal length; keep other columns. A missing array or unequal lengths fail the
    job: padding would invent values."""
    cols = {n: C.col(c) for n, c in arrays.items()}
    sizes = F.array(*[F.coalesce(F.size(c), F.lit(-1)) for c in cols.values()])
    sound = (F.array_min(sizes) == F.array_max(sizes)) & (F.array_min(sizes) >= 0)
    zipped = F.arrays_zip(*[c.alias(n) for n, c in cols.items()])
    checked = F.when(sound, zipped).otherwise(F.raise_error(F.lit("arrays are missing or differ in length")).cast(df.select(zipped).schema[0].dataType))
    return df.select("*", F.inline(checked))


DAILY_WEATHER = "city string, daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_sum:array<double>,wind_speed_10m_max:array<double>>"


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(DAILY_WEATHER).option("multiLine", "true").json(path)
    parts = {"date": "daily.time", "temp_max": "daily.temperature_2m_max", "temp_min": "daily.temperature_2m_min", "precipitation": "daily.precipitation_sum", "wind_speed": "daily.wind_speed_10m_max"}
    return explode_parallel_arrays(docs, parts).select("city", F.col("date").cast("date").alias("date"), *list(parts)[1:])


PRICE_CHART = (
    "symbol string, chart struct<error:string,result:array<struct<meta:struct<exchangeTimezoneName:string>,timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>,adjclose:array<struct<adjclose:array<double>>>>>>>"
)


def explode_price_bars(docs: DataFrame) -> DataFrame:
    """One bar for each timestamp, on the exchange's date, rounded to 4 places. Bars with a missing value go; a missing
    adjusted close is the close. An API error or an empty result fails the job, and so does a day that comes twice."""
    first = F.get("chart.result", F.lit(0))
    refused = F.when(F.col("chart.error").isNotNull(), F.concat_ws(": ", "symbol", "chart.error")).when(F.coalesce(F.size("chart.result"), F.lit(0)) < 1, F.concat_ws(": ", "symbol", F.lit("empty result")))
    docs = docs.withColumn("r", F.when(refused.isNull(), first).otherwise(F.raise_error(refused).cast(docs.select(first).schema[0].dataType)))
    quote = F.get("r.indicators.quote", F.lit(0))
    adjusted = F.coalesce(F.get("r.indicators.adjclose", F.lit(0))["adjclose"], quote["close"])
    names = ("open", "high", "low", "close", "volume")
    bars = explode_parallel_arrays(docs, {"ts": F.col("r.timestamp"), **{n: quote[n] for n in names}, "adj_close": adjusted})
    zone = F.coalesce("r.meta.exchangeTimezoneName", F.lit("UTC"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("ts"), zone))
    bars = bars.dropna(subset=[*names, "adj_close"]).withColumn("trade_date", day)
    price = lambda c: F.round(c, 4).cast("decimal(14,4)").alias(c)
    rows = bars.groupBy("symbol", "trade_date").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*names, "adj_close")])
    once = F.when(F.col("n") == 1, F.col("symbol")).otherwise(F.raise_error(F.concat_ws(": ", "symbol", F.lit("duplicate trading days"))).cast("string"))
    return rows.select(once.alias("symbol"), "trade_date", *[price(c) for c in ("open", "high", "low", "close", "adj_close")], F.col("volume").cast("bigint").alias("volume"))


STATION_SNAPSHOT = (
    "snapshot_id string, taken_at timestamp, information struct<data:struct<stations:array<struct<station_id:bigint,stationCode:string,name:string,lat:double,lon:double,capacity:int>>>>,"
    "status struct<data:struct<stations:array<struct<station_id:bigint,stationCode:string,num_bikes_available_types:array<struct<mechanical:int,ebike:int>>,num_docks_available:int,"
    "is_installed:int,is_renting:int,is_returning:int,last_reported:bigint>>>>"
)


def read_gz_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped JSON objects, one for each file, under date= folders; snapshot_id is the file's name where the object has none."""
    docs = spark.read.schema(STATION_SNAPSHOT).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return docs.withColumn("snapshot_id", F.coalesce("snapshot_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)))


def flatten_station_status(snapshots: DataFrame) -> DataFrame:
    s = snapshots.select("snapshot_id", "taken_at", F.explode("status.data.stations").alias("s"))
    bikes = lambda kind: F.aggregate(F.coalesce(F.col("s.num_bikes_available_types"), F.array()), F.lit(0), lambda a, x: F.coalesce(x[kind], a)).alias(kind)
    flag = lambda c: (F.coalesce(F.col(f"s.{c}"), F.lit(0)) != 0).alias(c)
    return s.select(
        "snapshot_id", "taken_at", "s.station_id", F.col("s.stationCode").alias("station_code"), bikes("mechanical"), bikes("ebike"),
        F.coalesce("s.num_docks_available", F.lit(0)).alias("docks"), flag("is_installed"), flag("is_renting"), flag("is_returning"),
        F.timestamp_seconds(F.nullif("s.last_reported", F.lit(0))).alias("last_reported"),
    )


def flatten_station_info(snapshots: DataFrame) -> DataFrame:
    s = snapshots.select("taken_at", F.explode("information.data.stations").alias("s"))
    return s.select("s.station_id", F.col("s.stationCode").alias("station_code"), "s.name", "s.lat", "s.lon", F.coalesce("s.capacity", F.lit(0)).alias("capacity"), F.col("taken_at").alias("seen_at"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files below path, listed by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger (path) does not list."""
    return files.join(ledger.select("path"), "path", "left_anti")


def latest_delivery(files: DataFrame, period: str, delivered: str) -> DataFrame:
    """Of several deliveries of a period, the newest. period and delivered: expressions with one group, over path."""
    found = files.select("path", F.regexp_extract("path", period, 1).alias("period"), F.regexp_extract("path", delivered, 1).alias("delivered"))
    return found.where("period <> ''").groupBy("period").agg(F.max_by("path", F.struct("delivered", "path")).alias("path"), F.max("delivered").alias("delivered"))


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv_typed(spark, path, schema)


def lines_for_day(feed: DataFrame, ts: str, day: str, order: list[str]) -> DataFrame:
    """One day's rows in source order; a range on the timestamp, so it reaches the scan."""
    start = F.lit(day).cast("date")
    return feed.where((F.col(ts) >= start) & (F.col(ts) < F.date_add(start, 1))).orderBy(*order)


def lines_between(feed: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Rows from one day to another, both included; a range on the timestamp, so it reaches the scan."""
    return feed.where((F.col(ts) >= F.lit(first).cast("date")) & (F.col(ts) < F.date_add(F.lit(last).cast("date"), 1)))


def trading_days(feed: DataFrame, ts: str) -> DataFrame:
    return feed.select(F.to_date(ts).alias("day")).distinct()


def changes_since(df: DataFrame, column: str, last) -> DataFrame:
    """Rows added after the last processed version; all of them if there is none."""
    return df if last is None else df.where(F.col(column) > F.lit(last))


def named_queries(text: str) -> dict[str, str]:
    """{name: SQL} of a text with `-- name: x` lines."""
    parts = re.split(r"(?m)^--\s*name:\s*(\S+)\s*$", text)
    return {n: q.strip().rstrip(";").strip() for n, q in zip(parts[1::2], parts[2::2], strict=True)}


def run_named_queries(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    return {n: spark.sql(q) for n, q in named_queries(text).items()}
