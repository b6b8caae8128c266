"""Composed loads: a day that runs again, a sabotaged load, late snapshots, a medallion that has nothing to do."""

import json
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlib.operators import history as H
from martlib.operators import joins as J
from martlib.operators import quality as Q
from martlib.plans import flows
from martlib.sources import readers
from tests.conftest import plan_nodes, rows

LINES = "line_id long, invoice string, stock_code string, description string, quantity int, invoiced_at timestamp, unit_price decimal(10,2), customer_id long, country string"
DAY1 = [
    (1, "500001", "85123A", "HOLDER", 6, datetime(2011, 1, 10, 9), Decimal("2.55"), 100, "France"), (2, "500002", "85123A", "HOLDER", 1, datetime(2011, 1, 10, 10), Decimal("2.55"), None, "France"),
    (3, "C500003", "85123A", None, -2, datetime(2011, 1, 10, 11), Decimal("2.55"), 100, "France"), (4, "A500004", "B", "Adjust bad debt", 1, datetime(2011, 1, 10, 12), Decimal("-50.00"), None, "United Kingdom"),
]
DAY2 = [(5, "500005", "85123A", "HOLDER NEW", 3, datetime(2011, 3, 1, 9), Decimal("2.55"), 100, "Germany")]


def test_daily_batches(spark, tmp_path):
    loader = flows.DailyLoader(spark, str(tmp_path / "shop"))
    feed = spark.createDataFrame(DAY1 + DAY2, LINES)
    counts = loader.backfill(feed, ["2011-01-10", "2011-03-01"])
    assert [(c["raw"], c["facts"], c["rejected"]) for c in counts] == [(4, 3, 1), (1, 1, 0)]
    versions = rows(loader.customers().where("customer_id = 100"), "country", "valid_from", "is_current")
    assert versions == [("France", date(2011, 1, 10), False), ("Germany", date(2011, 3, 1), True)]
    before = rows(loader.facts(), "sales_line_id", "revenue", "line_type"), rows(loader.customers(), "customer_id", "country", "valid_from"), rows(loader.products())
    loader.run_batch(readers.lines_for_day(feed, "invoiced_at", "2011-01-10", ["line_id"]), "2011-01-10")
    assert (rows(loader.facts(), "sales_line_id", "revenue", "line_type"), rows(loader.customers(), "customer_id", "country", "valid_from"), rows(loader.products())) == before
    assert rows(loader.products()) == [("85123A", "HOLDER NEW"), ("B", "Adjust bad debt")]
    with pytest.raises(Q.ChecksFailed, match="not empty"):
        loader.run_batch(feed.limit(0), "2011-05-01")
    assert rows(loader.audit(), "status") == [("failed",), ("loaded",), ("loaded",), ("loaded",)]
    assert rows(loader.facts(), "sales_line_id") == [(1,), (2,), (3,), (5,)]
    rebuilt = H.scd2_rebuild(feed.where("customer_id IS NOT NULL"), "customer_id", "country", "invoiced_at", ["line_id"]).select("customer_id", "country", "valid_from", "valid_to", "is_current")
    assert J.diff(rebuilt, loader.customers().where("customer_id IS NOT NULL")).count() == 0
    assert flows.revenue_matches(loader.facts(), loader.facts()).first()["passed"]


def state(loader):
    return rows(loader.facts(), "sales_line_id", "revenue", "line_type"), rows(loader.customers(), "customer_id", "country", "valid_from", "valid_to", "is_current"), rows(loader.products())


def test_all_days_at_once_equal_one_after_another(spark, tmp_path):
    feed = spark.createDataFrame(DAY1 + DAY2, LINES)
    daily, once = flows.DailyLoader(spark, str(tmp_path / "daily")), flows.DailyLoader(spark, str(tmp_path / "once"))
    daily.backfill(feed, ["2011-01-10", "2011-03-01"])
    assert once.rebuild(feed)["facts"] == 4
    assert state(once) == state(daily)
    once.run_batch(readers.lines_for_day(feed, "invoiced_at", "2011-03-01", ["line_id"]), "2011-03-01")
    assert state(once) == state(daily)


def test_a_run_that_stops_before_publication_changes_nothing(spark, tmp_path, monkeypatch):
    feed = spark.createDataFrame(DAY1 + DAY2, LINES)
    loader = flows.DailyLoader(spark, str(tmp_path / "shop"))
    loader.run_batch(readers.lines_for_day(feed, "invoiced_at", "2011-01-10", ["line_id"]), "2011-01-10")
    before = state(loader)

    def stop(run):
        raise RuntimeError("the machine went away")

    with monkeypatch.context() as m:
        m.setattr(loader.tables, "publish", stop)
        with pytest.raises(RuntimeError):
            loader.run_batch(readers.lines_for_day(feed, "invoiced_at", "2011-03-01", ["line_id"]), "2011-03-01")
    assert state(loader) == before
    loader.run_batch(readers.lines_for_day(feed, "invoiced_at", "2011-03-01", ["line_id"]), "2011-03-01")
    assert rows(loader.facts(), "sales_line_id") == [(1,), (2,), (3,), (5,)]


def test_snapshots(spark, tmp_path):
    def doc(name, minute, capacity):
        s = {"station_id": 1, "stationCode": "16107", "num_bikes_available_types": [{"mechanical": 2}], "num_docks_available": 3, "is_installed": 1, "is_renting": 1, "is_returning": 1}
        i = {"station_id": 1, "stationCode": "16107", "name": "n", "lat": 1.0, "lon": 2.0, "capacity": capacity}
        return json.dumps({"snapshot_id": name, "taken_at": f"2024-01-01T10:{minute:02d}:00Z", "status": {"data": {"stations": [s]}}, "information": {"data": {"stations": [i]}}})

    read = lambda *docs: spark.read.schema(readers.STATION_SNAPSHOT).json(spark.sparkContext.parallelize(docs))
    root = str(tmp_path)
    assert flows.load_snapshot(spark, root, read(doc("b", 10, 30))) == 1
    assert flows.load_snapshot(spark, root, read(doc("b", 10, 30))) == 0
    assert flows.load_snapshot(spark, root, read(doc("a", 5, 99), doc("c", 15, 40), doc("c", 15, 40))) == 2
    assert flows.load_snapshot(spark, root, read(doc("z", 1, 77))) == 1
    assert rows(flows.read_stations(spark, root), "capacity") == [(40,)]
    cut = str(tmp_path / "cut")  # a load that stopped after its stations were published is done again
    stations = flows.Publisher(spark, f"{cut}/stations")
    stations.write("r", "stations", readers.flatten_station_info(read(doc("a", 5, 99))))
    stations.publish("r")
    assert flows.load_snapshot(spark, cut, read(doc("a", 5, 99))) == 1
    assert rows(flows.read_stations(spark, cut), "capacity") == [(99,)] and spark.read.parquet(f"{cut}/status").count() == 1


def event(i, day, kind, **more):
    return json.dumps({"event_id": str(i), "event_time": f"{day}T10:00:00", "user_id": "u", "session_id": f"s{i}", "event_type": kind, "page": "/", "product_id": "P1", "price": 2.0} | more)


def test_medallion(spark, tmp_path):
    land = tmp_path / "land"
    (land / "2024-01-01").mkdir(parents=True)
    (land / "2024-01-01/a.jsonl").write_text("\n".join([event(1, "2024-01-01", "product_view"), event(2, "2024-01-01", "purchase"), "broken"]))
    m = flows.Medallion(spark, str(tmp_path / "lake"))
    assert m.run(str(land)) == {"lines": 3, "inserted": 2, "rejected": 1, "dates": 1}
    assert m.run(str(land)) == {"lines": 0, "inserted": 0, "rejected": 0, "dates": 0}
    (land / "2024-01-02").mkdir()
    (land / "2024-01-02/b.jsonl").write_text("\n".join([event(2, "2024-01-01", "purchase"), event(3, "2024-01-02", "page_view", device="phone")]))
    assert m.run(str(land)) == {"lines": 2, "inserted": 1, "rejected": 0, "dates": 1}
    silver = spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "lake/silver"))
    assert rows(silver, "event_id", "device") == [("1", None), ("2", None), ("3", "phone")]
    gold = spark.read.parquet(str(tmp_path / "lake/daily_funnel"))
    assert rows(gold.withColumn("d", F.col("event_date").cast("string")), "d", "sessions", "purchase_pct") == [("2024-01-01", 2, 50.0), ("2024-01-02", 1, 0.0)]
    assert rows(flows.snapshot_check(spark.createDataFrame([], flows.CUSTOMERS), spark.createDataFrame([(1, "x")], "customer_id long, country string"), "customer_id", ["country"], "2024-01-01"), "country") == [("x",)]


def histories(spark, seed):
    """Lines of a few customers over a month, several a day, countries changing back and forth."""
    rng = random.Random(seed)
    return [
        (i, str(500000 + i), "85123A", "HOLDER", rng.choice([1, 2, 0]), datetime(2011, 1, rng.randint(1, 28), rng.randint(0, 23)), Decimal("2.50"), rng.choice([1, 2, 3, None]), rng.choice(["France", "Spain"]))
        for i in range(120)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_days_in_any_order_and_number(spark, tmp_path, seed):
    """Any cut of the days into runs, in any order, with days that run again and change, leaves what all days at once leave."""
    rng, lines = random.Random(seed), histories(spark, seed)
    feed = spark.createDataFrame(lines, LINES)
    days = sorted({str(r[5].date()) for r in lines})
    rng.shuffle(days)
    some, loader, once = days[:-3], flows.DailyLoader(spark, str(tmp_path / "some")), flows.DailyLoader(spark, str(tmp_path / "once"))
    first = spark.createDataFrame([r[:7] + (4 - (r[7] or 1), "Italy") if str(r[5].date()) == some[0] else r for r in lines], LINES)
    loader.backfill(first, some[:5], at_once=5)  # its first day has other customers and countries, and is corrected below
    loader.backfill(feed, some[5:], at_once=4)
    loader.backfill(feed, [some[0], some[-1]], at_once=2)
    once.rebuild(feed.where(F.to_date("invoiced_at").cast("string").isin(some)))
    members = lambda x: rows(x.customers().where("customer_id IS NOT NULL"), "customer_id", "country", "valid_from", "valid_to", "is_current")
    assert members(loader) == members(once)
    sold = lambda x: rows(x.sales(), "sales_line_id", "customer_id", "valid_from", "valid_to")
    assert sold(loader) == sold(once)
    before = sold(loader), members(loader)
    loader.clean()
    assert (sold(loader), members(loader)) == before and len(list((tmp_path / "some/runs").iterdir())) == 2
    loader.run_batch(readers.lines_for_day(feed, "invoiced_at", days[-1], ["line_id"]), days[-1])
    assert loader.facts().count() == once.facts().count() + sum(str(r[5].date()) == days[-1] and r[4] != 0 for r in lines)


def test_versions_are_looked_up_by_member_and_day(spark, tmp_path, monkeypatch):
    """Not line by line: four good lines are of two members on three days."""
    looked, whole = [], J.resolve_member
    monkeypatch.setattr(J, "resolve_member", lambda fact, *more: looked.append(fact.count()) or whole(fact, *more))
    counts = flows.DailyLoader(spark, str(tmp_path / "shop")).rebuild(spark.createDataFrame(DAY1 + DAY2, LINES))
    assert (counts["raw"], counts["facts"], looked) == (5, 4, [3])


def test_every_run_is_written_down(spark, tmp_path, monkeypatch):
    """Checks and counts of a good run; a run that fails a check; one that breaks before its checks; one with lines of other days."""
    feed = spark.createDataFrame(DAY1 + DAY2, LINES)
    loader = flows.DailyLoader(spark, str(tmp_path / "shop"))
    day1 = readers.lines_for_day(feed, "invoiced_at", "2011-01-10", ["line_id"])
    loader.run_batch(day1, "2011-01-10")
    assert rows(loader.audit(), "raw", "facts", "rejected", "status", "error") == [(4, 3, 1, "loaded", None)]
    assert rows(loader.checks(), "passed") == [(True,)] * 7
    whole = J.resolve_member
    with monkeypatch.context() as m:  # guests are lost
        m.setattr(J, "resolve_member", lambda fact, *more: whole(fact.where("customer_id IS NOT NULL"), *more))
        with pytest.raises(Q.ChecksFailed, match="every line is loaded or rejected, revenue reconciles"):
            loader.run_batch(day1, "2011-01-10")
    assert rows(loader.checks().where("NOT passed"), "check_name", "observed") == [("every line is loaded or rejected", 1.0), ("revenue reconciles", 2.55)]
    with pytest.raises(Exception, match="COLUMN"):
        loader.run_batch(day1.drop("country"), "2011-01-10")
    with pytest.raises(Q.ChecksFailed, match="days named"):
        loader.run_batch(feed, "2011-03-01")
    last = loader.audit().orderBy("started_at").select("status", "raw", F.col("error").isNotNull().alias("said"), (F.col("finished_at") >= F.col("started_at")).alias("timed"))
    assert [tuple(r) for r in last.collect()] == [("loaded", 4, False, True), ("failed", 4, True, True), ("failed", None, True, True), ("failed", 1, True, True)]
    assert rows(loader.facts(), "sales_line_id") == [(1,), (2,), (3,)]


def test_medallion_without_files(spark, tmp_path):
    (tmp_path / "land").mkdir()
    m = flows.Medallion(spark, str(tmp_path / "lake"))
    for _ in range(2):
        assert m.run(str(tmp_path / "land")) == {"lines": 0, "inserted": 0, "rejected": 0, "dates": 0}
    (tmp_path / "land/a.jsonl").write_text(event(1, "2024-01-01", "product_view"))
    assert m.run(str(tmp_path / "land"))["inserted"] == 1


def test_silver_caches_no_lines(spark, tmp_path):
    """A task reads splits of files, not cached partitions, whose size nothing bounds; the judged events go when the run ends."""
    (tmp_path / "land").mkdir()
    m = flows.Medallion(spark, str(tmp_path / "lake"))
    for k in (1, 2):
        (tmp_path / f"land/{k}.jsonl").write_text("\n".join([event(k, "2024-01-01", "product_view", **{"a b": k, "e.f": {"x": k}}), "broken"]))
        m.bronze(str(tmp_path / "land"))
        done: dict = {}
        nodes = plan_nodes(spark, lambda: done.update(m.silver()))  # noqa: B023
        assert done == {"inserted": 1, "rejected": 1}
        assert any("parquet" in name for name, _ in nodes) and not [name for name, _ in nodes if "InMemory" in name]
        assert not (tmp_path / "lake/judged").exists()
    assert rows(m.events(), "`a b`", "`e.f`.x") == [(1, 1), (2, 2)]
