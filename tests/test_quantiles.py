"""Order statistics, medians, score cuts, as-of joins and additive distinct counts against plain forms."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlib.operators import aggregates as A
from martlib.operators import joins as J
from martlib.operators import quantiles as Q
from martlib.operators import windows as W
from tests.conftest import plan_nodes, rows

VALUES = {
    "long": ([3, 3, None, -(2**62), 2**62, 2**62 - 1, 0, 1] + list(range(50)), "long"),
    "double": ([1.5, None, float("nan"), float("-inf"), 1e300, -1e300, 1e-300, 0.0, 2.0] + [x / 7 for x in range(60)], "double"),
    "decimal": ([Decimal(x).scaleb(-2) for x in (5, 7, 7, 7, -100, 10**12)], "decimal(18,2)"),
    "date": ([date(2020, 1, 1) + timedelta(days=x * x) for x in range(30)], "date"),
    "timestamp": ([datetime(2020, 1, 1, 0, 0, 0, x) for x in (1, 2, 3, 999)], "timestamp"),
    "one": ([4, 4, 4, 4], "int"), "none": ([None, None], "int"),
}


@pytest.mark.parametrize("name", sorted(VALUES))
def test_every_place(spark, name, monkeypatch):
    """Each place of each group, by wide and by narrow steps, null group included; values keep their type."""
    values, kind = VALUES[name]
    data = [(g, v) for g in ("a", None) for v in (values if g else values[::-1][: len(values) // 2])]
    df = spark.createDataFrame(data, f"g string, v {kind}")
    for buckets in (4096, 4):
        monkeypatch.setattr(Q, "BUCKETS", buckets)
        got = Q.order_statistics(df, ["g"], "v", {"low": "0", "lower": "(n - 1) div 2", "upper": "n div 2", "top": "n - 1", "past": "n"})
        assert got.schema["v"].dataType.simpleString() == kind.replace("long", "bigint")
        want = []
        for g in ("a", None):
            x = sorted(v for k, v in data if k == g and v is not None and v == v)
            want += [(g, p, len(x), x[i]) for p, i in (("low", 0), ("lower", (len(x) - 1) // 2), ("upper", len(x) // 2), ("top", len(x) - 1)) if x]
        assert rows(got, "g", "place", "n", "v") == rows(spark.createDataFrame(want, f"g string, place string, n long, v {kind}"))


def test_exact_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", 3), ("b", None), (None, 7), (None, 8), (None, 9), ("c", None)], "g string, v int")
    assert rows(Q.exact_median(df, ["g"], "v", "m")) == rows(df.groupBy("g").agg(F.median("v").alias("m")))
    assert Q.exact_median(df.limit(0), ["g"], "v", "m").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_scores_equal_the_window(spark, n):
    """Ties that hold most rows, nulls, NaN and infinities, of exact and of floating columns."""
    df = spark.range(n).select("id", F.expr("if(id % 5 < 3, 7, cast(id as int))").alias("x"), F.expr("if(id % 4 = 0, null, if(id % 7 = 1, double('infinity'), cast(id % 6 as double)))").alias("y"), F.expr("cast(null as date)").alias("z"))
    for k in (1, 3, 5):
        rank = lambda c: F.least(F.lit(k), 1 + F.floor(k * F.percent_rank().over(W.Window.orderBy(c)))).cast("int")  # noqa: B023, E731
        got = W.percent_rank_scores(df, {"sx": "x", "sy": "y", "sz": "z"}, k)
        assert rows(got, "id", "sx", "sy", "sz") == rows(df.select("id", rank("x"), rank("y"), rank("z")))
    assert "Window" not in W.percent_rank_scores(df, {"sx": "x"})._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_as_of_join(spark, how, partitions):
    """Both ends included, gaps, facts before and after all versions, a key with most facts and versions, null keys and days, a key
    without versions, repeated facts; over one range and over more ranges than keys."""
    day = lambda n: date(2020, 1, 1) + timedelta(days=n)
    versions = [(1, day(5 * i), day(5 * i + 3), i) for i in range(40)] + [(2, day(10), day(20), 100), (None, day(0), day(50), 101), (4, day(3), day(3), 102), (5, None, day(9), 103)]
    facts = [(i, 1 if i % 3 else 2, datetime(2020, 1, 1, 12) + timedelta(days=i % 230 - 10)) for i in range(600)]
    facts += [(900, None, datetime(2020, 1, 2)), (901, 2, None), (902, 3, datetime(2020, 1, 2)), (903, 4, datetime(2020, 1, 4, 23)), (903, 4, datetime(2020, 1, 4, 23)), (904, 4, datetime(2020, 1, 5)), (905, 5, datetime(2020, 1, 5))]
    f, v = spark.createDataFrame(facts, "id long, k long, at timestamp"), spark.createDataFrame(versions, "k long, valid_from date, valid_to date, n int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = J.as_of_join(f, v, "k", "at", how)
        assert rows(got, "id", "k", "at", "n", "valid_from") == rows(J.point_in_time_join(f, v, "k", "at", how), "id", "k", "at", "n", "valid_from")
        assert ">=" not in got._jdf.queryExecution().optimizedPlan().toString().replace("=> ", "") or "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    lasting = J.as_of_join(f, v.drop("valid_to"), "k", "at", how, end=None)
    assert lasting.where("id = 904").first()["n"] == 102
    assert J.as_of_join(f.limit(0), v, "k", "at", how).count() == 0
    assert J.as_of_join(f, v.limit(0), "k", "at", how).count() == (len(facts) if how == "left" else 0)
    with pytest.raises(ValueError, match="both sides"):
        J.as_of_join(f.withColumn("n", F.lit(1)), v, "k", "at", how)


def test_bitmaps_add_up(spark):
    df = spark.range(70_000).select(F.expr("cast(id % 3 as int)").alias("a"), F.expr("cast(id % 2 as int)").alias("b"), F.expr("if(id % 11 = 0, null, concat('u', id div 2))").alias("u"))
    fine = A.distinct_bitmaps(df, ["a", "b"], "u")
    for keys in (["a", "b"], ["a"], ["b"], []):
        want = df.groupBy(*keys).agg(F.count_distinct("u").alias("n"))
        assert rows(A.count_bitmaps(A.merge_bitmaps(fine, keys), keys, "n")) == rows(want)
    assert A.distinct_bitmaps(df.limit(0), ["a"], "u").count() == 0


def test_salted_join_without_keys(spark):
    big = spark.range(300).select(F.expr("if(id % 2 = 0, null, if(id % 3 = 0, 1, id))").alias("k"), "id")
    small = spark.createDataFrame([(1, "x"), (5, "y"), (None, "z")], "k long, name string")
    for how in ("left", "inner"):
        assert rows(J.salted_join(big, small, "k", 4, how), "k", "id", "name") == rows(big.join(small, "k", how), "k", "id", "name")


def test_places_share_their_ranges(spark):
    """A row is counted once a round, not once for each place; long values over the whole range of a long."""
    values = [(-(2**63) + i if i % 2 else 2**63 - 1 - i * i, i) for i in range(3000)]
    df = spark.createDataFrame(values, "x long, id long")
    found: dict = {}
    nodes = plan_nodes(spark, lambda: found.update(Q.percent_rank_cuts(df, ["x", "id"], 32)))
    for n, c in enumerate(("x", "id")):
        assert found[c] == [sorted(v[n] for v in values)[-(-s * 2999 // 32) - 1] for s in range(1, 32)]
    counted = [int(m["number of output rows"].replace(",", "")) for name, m in nodes if "Join" in name and m.get("number of output rows")]
    assert max(counted) <= 6000
