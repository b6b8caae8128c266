"""Composed loads: daily batches, station snapshots, and files to bronze, silver and gold. Each is safe to run again."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.functions import columns as C
from martlib.operators import clean as P
from martlib.operators import history as H
from martlib.operators import joins as J
from martlib.operators import quality as Q
from martlib.operators import variants as V
from martlib.operators.windows import latest_per_key
from martlib.plans import marts as K
from martlib.sources import readers as R
from martlib.sources.writers import Publisher, State, _delete, _fs, full_reload, overwrite_partitions, quarantine

CUSTOMERS = "customer_id long, country string, valid_from date, valid_to date, is_current boolean"
BRONZE = "value string, _source_file string, _ingested_at timestamp, _landing_date date"
#: The columns of silver before the source adds any.
SILVER = [*P.EVENT_SCHEMA.fieldNames(), "event_date", "batch", "_source_file", "_landing_date"]
LEDGER = "load long, path string, digest string"
DAYS = "day string, run string"
RUNS = "run_id string, batch_date date, started_at timestamp, finished_at timestamp, raw long, facts long, rejected long, status string, error string"
CHECKS = "run_id string, check_name string, severity string, passed boolean, observed double"
PRODUCTS = "stock_code string, product_description string, invoiced_at timestamp, sales_line_id long"


def ingest_new_files(spark: SparkSession, path: str, bronze: str, checkpoint: str) -> int:
    """Lines of the files not seen before, appended by landing date; how many. The checkpoint is the ledger: a missed run
    catches up, and another run ingests nothing."""
    lines = R.read_lines_with_lineage(spark, path, stream=True)
    query = lines.writeStream.format("parquet").partitionBy("_landing_date").option("path", bronze).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def ingest_by_content(spark: SparkSession, path: str, root: str) -> dict:
    """Lines of files whose content was never loaded, whatever their names, to root/bronze by load; how many files and lines.

    The ledger (root/ledger: load, path, digest) knows files by the SHA-256 of their bytes: one that is delivered again under another
    name, or twice in one run, is loaded once, and one that has changed under its old name is loaded again. Lines are
    written before the ledger, under the load's number, so a run that stops in between is done again and replaces itself.
    A file is read whole by one task to be hashed; it can have 2 GB.
    """
    fs, p = _fs(spark, f"{root}/ledger")
    ledger = spark.read.parquet(f"{root}/ledger") if fs.exists(p) else spark.createDataFrame([], LEDGER)
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = seen.select("path", C.content_digest("content").alias("digest")).groupBy("digest").agg(F.min("path").alias("path"))
    new = files.join(ledger.select("digest"), "digest", "left_anti").persist()
    try:
        load = 1 + (ledger.agg(F.max("load").alias("m")).first()["m"] or 0)
        paths = [r["path"] for r in new.select("path").collect()]  # the files of one load
        if not paths:
            return {"files": 0, "lines": 0}
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_source_file")).where(F.trim("value") != "")
        overwrite_partitions(lines.withColumn("load", F.lit(load)), f"{root}/bronze", ["load"])
        new.select(F.lit(load).cast("long").alias("load"), "path", "digest").coalesce(1).write.mode("append").parquet(f"{root}/ledger")
        wrote = spark.read.schema("value string, _source_file string, load long").parquet(f"{root}/bronze").where(F.col("load") == load)
        return {"files": len(paths), "lines": wrote.count()}
    finally:
        new.unpersist()


def snapshot_check(dim: DataFrame, current: DataFrame, key: str, attributes: list[str], at: str) -> DataFrame:
    """Versions by what changed between two looks at a table: the merge, with the day of the look."""
    return H.scd2_merge(dim, current.select(key, *attributes), key, attributes, at)


def _in_days(column: str, days: list[str], kind: str = "DATE") -> Column:
    """Whether a column is one of the days; one expression, however many there are. Days are checked to be dates."""
    named = ", ".join(f"{kind} '{date.fromisoformat(d)}'" for d in days)
    return F.expr(f"coalesce({column} IN ({named}), false)") if days else F.lit(False)


class DailyLoader:
    """Retail lines by day: customers (SCD 2, guests by country), products (SCD 1), facts, and an audit of every run.

    A run takes any set of days, late ones too. It writes under its own id, is checked, and is published only if every critical
    check passes. Which run holds each day is a table of the run as well, so facts and dimensions change together when the one
    pointer moves, and a day that runs again replaces itself. Facts name their customer and day; the version is found on
    reading (sales()), because a late day can move the versions of days that were loaded before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), Publisher(spark, root)

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self.tables.read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _appended(self, name: str, schema: str | None = None) -> DataFrame | None:
        fs, p = _fs(self.spark, f"{self.root}/{name}")
        if fs.exists(p):
            return self.spark.read.parquet(f"{self.root}/{name}")
        return None if schema is None else self.spark.createDataFrame([], schema)

    def run_batch(self, lines: DataFrame, day: str) -> dict:
        """One day. lines: line_id, invoice, stock_code, description, quantity, invoiced_at, unit_price, customer_id, country."""
        return self.run_days(lines, [day])

    def run_days(self, lines: DataFrame, days: list[str]) -> dict:
        """Any days in one run. Lines of other days fail it; a day without lines is loaded, and has none."""
        return self._run(lines, days, afresh=False)

    def rebuild(self, feed: DataFrame) -> dict:
        """All days of the feed in one run, with what a backfill day by day would leave. The feed is a table, not a batch: it
        replaces customers, products and facts of all days."""
        return self._run(feed, None, afresh=True)

    def backfill(self, feed: DataFrame, days: list[str], at_once: int = 50) -> list[dict]:
        """at_once days in each run, in the given order; a run reads from its first day to its last, so it is a pruned read. Returns the
        counts of each day."""
        done = []
        for i in range(0, len(days), at_once):
            some = days[i : i + at_once]
            span = R.lines_between(feed, "invoiced_at", min(some), max(some))
            counts = self.run_days(span.where(_in_days("to_date(invoiced_at)", some)), some)["days"]
            done += [{"raw": counts[d][0], "facts": counts[d][1], "rejected": counts[d][0] - counts[d][1], "failed": []} for d in some]
        return done

    def _run(self, lines: DataFrame, days: list[str] | None, afresh: bool) -> dict:
        run, started = f"{days[0] if days else 'rebuild'}-{uuid.uuid4().hex[:8]}", datetime.now(timezone.utc)
        counts, checks, error = {}, [], None
        try:
            counts, checks = self._write(run, lines, days, afresh)
            if failed := [c[0] for c in checks if not c[2] and c[1] == "critical"]:
                raise Q.ChecksFailed(", ".join(failed))
            by_day = self.spark.createDataFrame([(d, run) for d in days or counts], DAYS)
            self.tables.write(run, "days", by_day if afresh else H.upsert(self._read("days", DAYS), by_day, ["day"]))
            self.tables.publish(run)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:2000]
            raise
        finally:
            self._record(run, started, days or sorted(counts), counts, checks, error)
        raw, facts = (sum(c[k] for c in counts.values()) for k in (0, 1))
        return {"raw": raw, "facts": facts, "rejected": raw - facts, "failed": [], "days": counts}

    def _write(self, run: str, lines: DataFrame, days: list[str] | None, afresh: bool) -> tuple[dict, list[tuple]]:
        """({day: (lines, facts)}, checks) of a run whose tables are written. The lines are read once; what the checks need of them
        is counted by that read and by the write of the facts."""
        seen_lines, seen_facts = Observation(), Observation()
        good, money = ~F.col("is_rejected"), F.col("revenue").cast("decimal(38,2)")
        staged = P.stage_sales_lines(lines.withColumn("batch_date", F.to_date("invoiced_at")))
        strange = F.lit(False) if days is None else ~_in_days("batch_date", days)
        staged = staged.observe(seen_lines, F.count(F.lit(1)).alias("lines"), F.count(F.when(~good, 1)).alias("rejected"), F.sum(F.when(good, money)).alias("revenue"), F.count(F.when(strange, 1)).alias("strange"))
        staged = self.tables.write(run, "staged", staged)
        good_lines = staged.where(good)

        published = self._read("days", DAYS)
        ours = F.lit(afresh) | _in_days("day", days or [], "")
        again, kept = published.where(F.lit(not afresh) & ours), published.where(~ours)
        sums = {"lines": F.count(F.lit(1)), "revenue": F.sum(money)}
        fresh = H.last_of_day(good_lines, "customer_id", "country", "invoiced_at", "sales_line_id", sums=sums, groups=True)
        fresh = fresh.withColumn("run", F.lit(run))
        overwrite_partitions(fresh, f"{self.root}/customer_days", ["run"], compression="zstd")
        shown = self.spark.read.schema(fresh.schema).parquet(f"{self.root}/customer_days")  # rows of earlier forms have no sums
        own, every = shown.where(F.col("run") == run).drop("run"), shown.where("customer_id IS NOT NULL").drop(*sums)
        of = lambda some: every.join(some.select(F.col("day").cast("date").alias("day"), "run"), ["day", "run"], "left_semi").drop("run")
        before = self._read("customers", CUSTOMERS).where(F.lit(not afresh))
        members, guests = before.where("customer_id IS NOT NULL"), before.where("customer_id IS NULL")
        merged = H.splice_versions(members, of(kept), of(again), every.where(F.col("run") == run).drop("run"), "customer_id", "country")
        new_guests = H.guest_members(guests, own, "customer_id", "country")
        customers = self.tables.write(run, "customers", merged.unionByName(guests).unionByName(new_guests))
        products = H.scd1_latest(self._read("products", PRODUCTS).where(F.lit(not afresh)), staged, "stock_code", "product_description", "invoiced_at", "sales_line_id")
        self.tables.write(run, "products", products)

        # each line has a version if the days of its member have: lines are written as they are, and days looked up
        resolved = J.resolve_member(own, customers, "customer_id", "day", "country").agg(F.sum("lines").alias("facts"), F.sum("revenue").alias("revenue")).first()
        odd = (F.col("line_type") == "sale") & (F.col("quantity") <= 0)
        facts = good_lines.observe(seen_facts, F.count(F.lit(1)).alias("facts"), F.sum(money).alias("revenue"), F.count(F.when(odd, 1)).alias("odd"))
        overwrite_partitions(facts.withColumn("run", F.lit(run)), f"{self.root}/facts", ["run"], compression="zstd")
        written = self.spark.read.parquet(f"{self.root}/facts").where(F.col("run") == run)
        raw_of, facts_of = ({str(r["batch_date"]): r["count"] for r in df.groupBy("batch_date").count().collect()} for df in (staged, written))  # a row for each day
        counts = {d: (raw_of.get(d, 0), facts_of.get(d, 0)) for d in sorted({*(days or []), *raw_of})}
        return counts, self._checks(seen_lines.get, seen_facts.get, resolved.asDict(), customers)

    def _checks(self, lines: dict, written: dict, resolved: dict, customers: DataFrame) -> list[tuple]:
        """(check_name, severity, passed, observed). written: the facts as they are; resolved: those that have a version, once for each."""
        members = customers.where("customer_id IS NOT NULL")
        many = Q.one_current_version(customers, "customer_id").agg(F.count("*").alias("n"))
        crossing = J.overlap_pairs(members, "customer_id").agg(F.count("*").alias("n"))
        broken = many.withColumn("kind", F.lit("current")).unionByName(crossing.withColumn("kind", F.lit("crossing"))).collect()  # two rows
        n = {r["kind"]: r["n"] for r in broken}
        good = lines["lines"] - lines["rejected"]
        lost = max((good - (facts["facts"] or 0) for facts in (written, resolved)), key=abs)
        gap = float(max(((lines["revenue"] or 0) - (facts["revenue"] or 0) for facts in (written, resolved)), key=abs))
        rows = [
            ("every line is loaded or rejected", lost == 0, float(lost)), ("revenue reconciles", gap == 0, gap), ("the load is not empty", lines["lines"] > 0, float(lines["lines"])),
            ("lines are of the days named", lines["strange"] == 0, float(lines["strange"])), ("one current version", n["current"] == 0, float(n["current"])),
            ("versions never overlap", n["crossing"] == 0, float(n["crossing"])), ("sales have positive quantity", written["odd"] == 0, float(written["odd"])),
        ]
        return [(name, "critical", passed, observed) for name, passed, observed in rows]

    def _record(self, run: str, started: datetime, days: list[str], counts: dict, checks: list[tuple], error: str | None) -> None:
        """What a run did, whether it failed or not: a row for each day, and one for each check."""
        now, status = datetime.now(timezone.utc), "failed" if error else "loaded"
        rows = [(run, date.fromisoformat(d), started, now, *((counts[d][0], counts[d][1], counts[d][0] - counts[d][1]) if d in counts else (None,) * 3), status, error) for d in days or ["0001-01-01"]]
        self.spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/audit_runs")
        if checks:
            self.spark.createDataFrame([(run, *c) for c in checks], CHECKS).coalesce(1).write.mode("append").parquet(f"{self.root}/audit_checks")

    def facts(self) -> DataFrame:
        """The rows of each day from the run that the published table of days names."""
        days = self._read("days", DAYS).select(F.col("day").cast("date").alias("batch_date"), "run")
        return self._appended("facts").join(days, ["batch_date", "run"], "left_semi").drop("run")

    def sales(self) -> DataFrame:
        """Facts with the version of their customer that holds on their day (valid_from, valid_to, is_current)."""
        return J.resolve_member(self.facts(), self.customers(), "customer_id", "invoiced_at", "country")

    def customers(self) -> DataFrame:
        return self._read("customers", CUSTOMERS)

    def products(self) -> DataFrame:
        return self._read("products", PRODUCTS).select("stock_code", "product_description")

    def audit(self) -> DataFrame:
        """A row for each run and day: counts, times, status and error."""
        return self._appended("audit_runs", RUNS)

    def checks(self) -> DataFrame:
        """A row for each run and check."""
        return self._appended("audit_checks", CHECKS)

    def clean(self) -> None:
        """Delete dimensions of runs that nothing names any more, and rows of days that other runs have replaced. Not for use while
        a run is being written."""
        named = {r["run"] for r in self._read("days", DAYS).select("run").distinct().collect()}  # a row for each run
        self.tables.clean()
        for name in ("facts", "customer_days"):
            fs, p = _fs(self.spark, f"{self.root}/{name}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName().startswith("run=") and s.getPath().getName().removeprefix("run=") not in named:
                    fs.delete(s.getPath(), True)


def read_stations(spark: SparkSession, root: str) -> DataFrame | None:
    return Publisher(spark, f"{root}/stations").read("stations")


def load_snapshot(spark: SparkSession, root: str, snapshots: DataFrame) -> int:
    """Status rows of snapshots that the log does not list, and the stations as last seen; how many rows were new.
    snapshots: documents of readers.STATION_SNAPSHOT. An earlier snapshot that comes late does not replace a station. Stations
    are published before the log is written: a run that ends in between is done again, and changes nothing twice."""
    fs, log = _fs(spark, f"{root}/status")
    fresh = snapshots
    if fs.exists(log):
        fresh = snapshots.join(spark.read.parquet(f"{root}/status").select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    status = R.flatten_station_status(fresh.dropDuplicates(["snapshot_id"])).withColumn("day", F.to_date("taken_at")).persist()
    n = status.count()
    if n:
        info = latest_per_key(R.flatten_station_info(fresh), ["station_id"], [F.desc("seen_at")])
        known, stations = read_stations(spark, root), Publisher(spark, f"{root}/stations")
        run = uuid.uuid4().hex
        stations.write(run, "stations", info if known is None else H.upsert_if_newer(known, info, ["station_id"], "seen_at"))
        stations.publish(run)
        status.write.mode("append").partitionBy("day").parquet(f"{root}/status")
    status.unpersist()
    return n


class Medallion:
    """Event files to bronze (lines), silver (one row for each event) and gold (funnel and products by day)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.state = State(spark, f"{self.root}/state")

    def _table(self, name: str) -> DataFrame | None:
        fs, p = _fs(self.spark, f"{self.root}/{name}")
        filled = fs.exists(p) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}") if filled else None

    def bronze(self, landing: str) -> int:
        return ingest_new_files(self.spark, landing, f"{self.root}/bronze", f"{self.root}/bronze_checkpoint")

    def silver(self) -> dict:
        """New lines as events; rejected lines go to quarantine. A run that is repeated after a crash writes its own rows again.

        Lines are parsed twice: for the fields that there are, and to be judged. Judged events are a table until the run ends, which
        tasks read in file splits; a cached split of bronze is many times as large, as lines are unpacked in it."""
        last = self.state.get("silver")
        new = R.changes_since(self._lines().withColumn("__v", F.unix_micros("_ingested_at")), "__v", last).withColumn("__object", V.parse_object())
        try:
            return self._silver(new)
        finally:
            _delete(self.spark, f"{self.root}/judged")

    def _lines(self) -> DataFrame:
        """Bronze by its own schema: before the first file arrives there is nothing to infer one from."""
        fs, p = _fs(self.spark, f"{self.root}/bronze")
        return self.spark.read.schema(BRONZE).parquet(f"{self.root}/bronze") if fs.exists(p) else self.spark.createDataFrame([], BRONZE)

    def _silver(self, new: DataFrame) -> dict:
        version, types = new.agg(F.max("__v"), V.field_types("__object")).first()
        if version is None:
            return {"inserted": 0, "rejected": 0}
        more = V.column_names(set(V.as_fields(types).fieldNames()) - set(P.EVENT_SCHEMA.fieldNames()), SILVER)
        judged = P.tag_events(new.select("value", P.event_struct("__object", more).alias("e"), "_source_file", "_landing_date"))
        full_reload(judged, f"{self.root}/judged")
        valid, bad = P.split_events(self.spark.read.schema(judged.schema).parquet(f"{self.root}/judged"), [*P.EVENT_SCHEMA.fieldNames(), *more])
        overwrite_partitions(self.spark.createDataFrame([(types, str(version))], "types string, batch string"), f"{self.root}/fields", ["batch"])
        seen = self._table("silver")
        if seen is not None:
            seen = seen.where(F.col("batch") != str(version)).join(valid.select("event_date").distinct(), "event_date", "left_semi")
            valid = H.new_rows(seen, valid, ["event_id"])
        overwrite_partitions(valid.withColumn("batch", F.lit(str(version))), f"{self.root}/silver", ["batch", "event_date"])
        quarantine(bad, f"{self.root}/quarantine", str(version))
        self.state.set("silver", version)
        events = self._table("silver")
        own = 0 if events is None else events.where(F.col("batch") == str(version)).count()
        rejected = self._table("quarantine")
        return {"inserted": own, "rejected": 0 if rejected is None else rejected.where(F.col("batch_id") == str(version)).count()}

    def fields(self) -> T.StructType:
        """The columns of silver that the source has added, with the type that holds what all batches sent. The schemas are read, of
        which there are as many as there were shapes of a batch; silver is not."""
        catalog = self._table("fields")
        shapes = [] if catalog is None else catalog.select("types").distinct().collect()
        merged = V.merge_fields(V.as_fields(r["types"]) for r in shapes)
        more = V.column_names(set(merged.fieldNames()) - set(P.EVENT_SCHEMA.fieldNames()), SILVER)
        return T.StructType([T.StructField(c, reduce(V.merge_types, [merged[n].dataType for n in names])) for c, names in more.items()])

    def events(self) -> DataFrame | None:
        """Silver with the added fields in their types; fields that were of several kinds are text. Files keep the text, so a field
        whose type changes rewrites nothing."""
        silver = self._table("silver")
        return None if silver is None else V.typed(silver, self.fields())

    def gold(self) -> int:
        """Recompute the dates that silver has changed, and no others; how many."""
        version, done = self.state.get("silver"), self.state.get("gold")
        events = self._table("silver")
        if events is None:
            return 0
        changed = events.where((F.col("batch").cast("long") > F.lit(done if done is not None else -1)) & (F.col("batch").cast("long") <= F.lit(version))).select("event_date").distinct().persist()
        if n := changed.count():
            days = events.join(changed, "event_date", "left_semi")
            overwrite_partitions(K.daily_funnel(days, {"product_view_pct": "product_view", "cart_pct": "add_to_cart", "purchase_pct": "purchase"}), f"{self.root}/daily_funnel", ["event_date"])
            overwrite_partitions(K.product_daily(days, "product_id", "product_view", "purchase", "price"), f"{self.root}/product_daily", ["event_date"])
        changed.unpersist()
        self.state.set("gold", version)
        return n

    def run(self, landing: str) -> dict:
        lines = self.bronze(landing)
        return {"lines": lines, **self.silver(), "dates": self.gold()}


def revenue_matches(lines: DataFrame, other: DataFrame) -> DataFrame:
    """Two builds of the facts hold the same revenue; for the incremental against the rebuilt warehouse."""
    return Q.sums_match(lines, "revenue", other, "revenue", "revenue of both builds")


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)
