"""Click events as a stream: validated, dead-lettered, deduplicated and counted, with the same result under replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martlib.operators.clean import EVENT_SCHEMA, parse_json, quality_verdict, stream_event_rules
from martlib.operators.history import add_counts, count_delta, new_rows
from martlib.sources.readers import read_lines_with_lineage
from martlib.sources.writers import _fs, overwrite_partitions


def read_clicks_stream(spark: SparkSession, source: dict[str, str]) -> DataFrame:
    """value and the source's own columns. {'path': folder} reads lines of new files, {'files_at_once': n} so many a batch; other
    options go to the message broker's connector, which must be on the class path (key, value, partition, offset)."""
    if "path" in source:
        return read_lines_with_lineage(spark, source["path"], stream=True, files_at_once=source.get("files_at_once"))
    stream = spark.readStream.format("kafka").options(**source).load()
    return stream.select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")


def write_dead_letters(rejected: DataFrame, servers: str, topic: str) -> None:
    """Rejected texts to a topic, the reason in a header; needs the connector."""
    header = F.array(F.struct(F.lit("error").alias("key"), F.col("reject_reason").cast("binary").alias("value")))
    rejected.select(F.col("value").cast("binary"), header.alias("headers")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").option("topic", topic).save()


def validate(stream: DataFrame, products: list[str]) -> DataFrame:
    """Append e (the event) and reject_reason (null if valid); works on a stream or a batch."""
    return quality_verdict(parse_json(stream, EVENT_SCHEMA), stream_event_rules(F.array(*[F.lit(p) for p in products])), "reject_reason", None)


def events_of(valid: DataFrame) -> DataFrame:
    fields = [F.col(f"e.{f.name}") for f in EVENT_SCHEMA.fields if f.name != "event_time"]
    return valid.select(*fields, F.try_to_timestamp(F.col("e.event_time")).alias("event_time")).withColumn("event_date", F.to_date("event_time"))


def minute_counts(events: DataFrame, ts: str = "event_time", kind: str = "event_type", value: str | None = "price") -> DataFrame:
    """Events and purchase revenue of each minute and type; late events count in their own minute."""
    revenue = F.sum(F.when(F.col(kind) == "purchase", F.col(value))) if value else F.lit(None).cast("double")
    window = F.window(F.col(ts).cast("timestamp"), "1 minute")
    return events.groupBy(window.alias("w"), kind).agg(F.count("*").alias("events"), revenue.alias("revenue")).select(F.col("w.start").alias("minute"), kind, "events", "revenue")


def with_lateness(events: DataFrame, ts: str, limit: str) -> DataFrame:
    """Bounded lateness: state is dropped once the watermark has passed; later events no longer count."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, limit)


def dedupe_within(events: DataFrame, key: str, ts: str, limit: str) -> DataFrame:
    """Drop repeats that come within limit of each other; state stays bounded."""
    return with_lateness(events, ts, limit).dropDuplicatesWithinWatermark([key])


def too_late(query: StreamingQuery) -> int:
    """How many rows a query has left out because the watermark had passed their time, in the batches that it remembers
    (spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def in_user_order(batch: DataFrame, user: str, ts: str) -> DataFrame:
    """Each user's events together and in order of time."""
    return batch.repartition(F.col(user)).sortWithinPartitions(user, ts)


class ClickSink:
    """The tables of a click stream under one folder: events (by event_date), dead_letters, counts and stats (by batch).

    A batch is written as a whole under its batch id, so that a replay of the batch replaces its own rows; an event that
    earlier batches have is not written again. Only the event dates in the batch are looked up, as a repeated event carries
    the same time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str) -> DataFrame | None:
        fs, p = _fs(self.spark, f"{self.root}/{name}")
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}") if fs.exists(p) else None

    def write_batch(self, tagged: DataFrame, batch_id: int) -> None:
        """tagged: the columns value, e and reject_reason of validate()."""
        tagged = tagged.persist()
        valid, bad = events_of(tagged.where("reject_reason IS NULL")), tagged.where("reject_reason IS NOT NULL").select("value", "reject_reason")
        seen = self._table("events")
        once = valid.dropDuplicates(["event_id"])
        if seen is not None:
            earlier = seen.where(F.col("batch_id") != batch_id).join(valid.select("event_date").distinct(), "event_date", "left_semi")
            once = new_rows(earlier, once, ["event_id"])
        fresh = once.persist()
        stats = tagged.agg(F.count("*").alias("received"), F.count("reject_reason").alias("invalid")).crossJoin(fresh.agg(F.count("*").alias("inserted")))
        stats = stats.withColumn("duplicates", F.col("received") - F.col("invalid") - F.col("inserted"))
        delta = count_delta(fresh.withColumn("minute", F.date_trunc("minute", "event_time")), batch_id, ["minute", "event_type"], {"events": F.count("*"), "revenue": F.sum(F.when(F.col("event_type") == "purchase", F.col("price")))})
        for name, df in (("dead_letters", bad), ("counts", delta.drop("batch_id")), ("stats", stats), ("events", fresh)):
            overwrite_partitions(df.withColumn("batch_id", F.lit(batch_id)), f"{self.root}/{name}", ["batch_id"] if name != "events" else ["batch_id", "event_date"])
        fresh.unpersist()
        tagged.unpersist()

    def start(self, stream: DataFrame, products: list[str], checkpoint: str) -> StreamingQuery:
        """Take what is there and stop; offsets are kept by the checkpoint after each batch is written."""
        return validate(stream, products).writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def events(self) -> DataFrame:
        return self._table("events")

    def dead_letters(self) -> DataFrame:
        return self._table("dead_letters")

    def stats(self) -> DataFrame:
        return self._table("stats")

    def minute_counts(self) -> DataFrame:
        return add_counts(self._table("counts"), ["minute", "event_type"], ["events", "revenue"])
