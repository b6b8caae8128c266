"""Merges are idempotent, and the replayed merge equals the rebuilt history."""

from datetime import date, datetime

from pyspark.sql import functions as F

from martlib.operators import history as H
from martlib.operators import joins as J
from tests.conftest import rows

COLUMNS = "customer long, country string, valid_from date, valid_to date, is_current boolean"
OPEN = date(9999, 12, 31)


def merge(dim, spark, data, day):
    return H.scd2_merge(dim, spark.createDataFrame(data, "customer long, country string"), "customer", ["country"], day)


def test_scd2_merge_cases(spark):
    empty = spark.createDataFrame([], COLUMNS)
    one = merge(empty, spark, [(1, "France"), (2, "Spain")], "2011-01-01")
    assert rows(one) == [(1, "France", date(2011, 1, 1), OPEN, True), (2, "Spain", date(2011, 1, 1), OPEN, True)]
    assert rows(merge(one, spark, [(1, "France")], "2011-02-01")) == rows(one)
    moved = merge(one, spark, [(1, "Germany"), (3, "EIRE")], "2011-02-01")
    want = [(1, "France", date(2011, 1, 1), date(2011, 1, 31), False), (1, "Germany", date(2011, 2, 1), OPEN, True), (2, "Spain", date(2011, 1, 1), OPEN, True), (3, "EIRE", date(2011, 2, 1), OPEN, True)]
    assert rows(moved) == want and rows(merge(moved, spark, [(1, "Germany"), (3, "EIRE")], "2011-02-01")) == want
    corrected = merge(moved, spark, [(1, "Italy")], "2011-02-01")
    assert (1, "Italy", date(2011, 2, 1), OPEN, True) in rows(corrected) and corrected.count() == 4
    assert rows(merge(moved, spark, [(1, "Japan")], "2011-01-15")) == want
    nulls = merge(moved, spark, [(1, None)], "2011-03-01")
    assert (1, None, date(2011, 3, 1), OPEN, True) in rows(nulls) and rows(merge(nulls, spark, [(1, None)], "2011-04-01")) == rows(nulls)


def test_replay_equals_rebuild(spark):
    data = [(i, i % 4, datetime(2011, 1, 1 + i * 7 % 5, i % 24), "ABC"[(i * i) % 3]) for i in range(40)]
    events = spark.createDataFrame(data, "line long, customer long, at timestamp, country string")
    whole = H.scd2_rebuild(events, "customer", "country", "at", ["line"]).select("customer", "country", "valid_from", "valid_to", "is_current")
    replay = H.scd2_replay(events, "customer", "country", "at", ["line"], [f"2011-01-0{k}" for k in range(1, 6)], spark.createDataFrame([], COLUMNS))
    assert rows(replay) == rows(whole) and J.overlap_pairs(whole, "customer").count() == 0


def test_scd1(spark):
    dim = spark.createDataFrame([("a", "old"), ("b", "keep")], "code string, text string")
    batch = spark.createDataFrame([("a", "new", 1), ("a", None, 2), ("b", None, 3), ("c", None, 4)], "code string, text string, n int")
    want = [("a", "new"), ("b", "keep"), ("c", None)]
    once = H.scd1_upsert(dim, batch, "code", "text", [F.desc("n")])
    assert rows(once) == want and rows(H.scd1_upsert(once, batch, "code", "text", [F.desc("n")])) == want


def test_loads(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, ts int")
    b = spark.createDataFrame([(2, "B", 4), (3, "C", 9)], "k int, v string, ts int")
    assert rows(H.upsert(t, b, ["k"])) == [(1, "a", 5), (2, "B", 4), (3, "C", 9)]
    assert rows(H.insert_new(t, b.union(b), ["k"])) == [(1, "a", 5), (2, "b", 5), (3, "C", 9)]
    assert rows(H.upsert_if_newer(t, b, ["k"], "ts")) == [(1, "a", 5), (2, "b", 5), (3, "C", 9)]
    assert rows(H.replace_batch(t, b.withColumn("ts", F.lit(5)), "ts")) == [(2, "B", 5), (3, "C", 5)]
    assert H.evolve_schema(t, b.withColumn("new", F.lit(1))).where("new IS NULL").count() == 2
    assert rows(H.assign_surrogate_keys(t.select(F.col("k").cast("long").alias("sk")), b.select("v"), "sk", ["v"]), "v", "sk") == [("B", 3), ("C", 4)]
    days = spark.createDataFrame([(1, date(2024, 1, 1), "x"), (2, date(2024, 1, 5), "x")], "k int, d date, v string")
    src = days.withColumn("v", F.lit("y")).unionByName(spark.createDataFrame([(3, date(2024, 1, 9), "y")], "k int, d date, v string"))
    assert rows(H.incremental(days, src, ["k"], "d", "2 DAYS"), "k", "v") == [(1, "x"), (2, "y"), (3, "y")]
    assert H.incremental(days.limit(0), src, ["k"], "d", "2 DAYS").count() == 3


def test_guests_and_members(spark):
    lines = spark.createDataFrame([(None, "France", datetime(2011, 1, 2)), (7, "Spain", datetime(2011, 1, 2)), (8, "Spain", datetime(2011, 1, 2))], "customer long, country string, at timestamp")
    dim = spark.createDataFrame([(7, "Spain", date(2011, 1, 1), OPEN, True)], COLUMNS)
    guests = H.guest_members(dim, lines, "customer", "country")
    members = dim.unionByName(guests)
    assert rows(guests, "country") == [("France",)] and H.guest_members(members, lines, "customer", "country").count() == 0
    assert rows(J.resolve_member(lines, members, "customer", "at", "country"), "customer", "country") == [(None, "France"), (7, "Spain")]
    assert rows(H.missing_members(dim.select("country"), lines, ["country"])) == [("France",)]


def test_counts_survive_a_replay(spark):
    new = spark.createDataFrame([("m1",), ("m1",), ("m2",)], "minute string")
    delta = H.count_delta(new, 1, ["minute"], {"events": F.count("*")})
    assert rows(H.add_counts(delta.union(delta), ["minute"], ["events"])) == rows(H.add_counts(delta, ["minute"], ["events"])) == [("m1", 2), ("m2", 1)]


def test_dim_date(spark):
    d = H.dim_date(spark, "2009-12-01", "2011-12-31")
    assert d.count() == 761
    assert tuple(d.where("date_key = 20110630").select("quarter", "iso_weekday", "is_weekend", "month_name").first()) == (2, 4, False, "June")


def test_null_keys_are_keys(spark):
    """Applied twice, each merge gives what it gave once, and a null key matches a null key."""
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    batch = spark.createDataFrame([(None, "new"), (2, "b")], "k long, v string")
    once = H.upsert(target, batch, ["k"])
    assert rows(once) == rows(H.upsert(once, batch, ["k"])) == [(None, "new"), (1, "a"), (2, "b")]
    once = H.insert_new(target, batch, ["k"])
    assert rows(once) == rows(H.insert_new(once, batch, ["k"])) == [(None, "n"), (1, "a"), (2, "b")]
    once = H.replace_batch(target, batch, "k")
    assert rows(once) == rows(H.replace_batch(once, batch, "k")) == [(None, "new"), (1, "a"), (2, "b")]
    once = H.recompute_changed(target, batch, batch, "k", lambda df: df)
    assert rows(once) == rows(H.recompute_changed(once, batch, batch, "k", lambda df: df)) == [(None, "new"), (1, "a"), (2, "b")]
    assert rows(H.scd1_upsert(target, batch, "k", "v", [])) == [(None, "new"), (1, "a"), (2, "b")]
    dim = spark.createDataFrame([], "k long, v string, valid_from date, valid_to date, is_current boolean")
    once = H.scd2_merge(dim, batch, "k", ["v"], "2024-01-01")
    assert rows(once) == rows(H.scd2_merge(once, batch, "k", ["v"], "2024-01-01")) and once.count() == 2
    guests = H.guest_members(dim, spark.createDataFrame([(None, None), (None, "x")], "k long, v string"), "k", "v")
    assert guests.count() == 2 and H.guest_members(guests, spark.createDataFrame([(None, None)], "k long, v string"), "k", "v").count() == 0


def test_calendar_of_a_column(spark):
    df = spark.createDataFrame([("2024-02-28",), ("2024-03-02",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    assert rows(H.dim_date_of(df, "d")) == rows(H.dim_date(spark, "2024-02-28", "2024-03-02")) and H.dim_date_of(df.limit(0), "d").count() == 0


def test_changes_of_merges(spark):
    """Applied changes equal the merge; null keys and values, rows that stay, deletes of what is not there, repeats, net changes."""
    schema = "k long, v string"
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n"), (5, "e")], schema)
    one = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (None, None), (6, "f"), (7, "gone"), (5, "gone")], schema)
    two = spark.createDataFrame([(2, "b"), (5, "E"), (6, "gone"), (8, "h")], schema)
    dead = F.col("v") == "gone"
    c1 = H.merge_with_changes(first, one, ["k"], dead)
    assert rows(c1, "change", "k", "v") == rows(spark.createDataFrame([
        ("update_before", 2, "b"), ("update_after", 2, "B"), ("update_before", 3, None), ("update_after", 3, "c"), ("update_before", None, "n"), ("update_after", None, None), ("insert", 6, "f"), ("delete", 5, "e"),
    ], "change string, k long, v string"))
    now = H.apply_changes(first, c1, ["k"])
    assert rows(now) == rows(spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (None, None), (6, "f")], schema))
    assert rows(H.apply_changes(now, c1, ["k"])) == rows(now)
    c2 = H.merge_with_changes(now, two, ["k"], dead)
    last = H.apply_changes(now, c2, ["k"])
    net = H.net_changes(c1.withColumn("version", F.lit(1)).unionByName(c2.withColumn("version", F.lit(2))), ["k"])
    assert rows(H.apply_changes(first, net, ["k"])) == rows(last)
    assert rows(net.where("k IN (2, 6)")) == [] and rows(net.where("k = 5"), "change", "v") == [("update_after", "E"), ("update_before", "e")]
    assert H.merge_with_changes(now, now, ["k"]).count() == 0
    assert H.merge_with_changes(first.limit(0), first, ["k"]).count() == 5
