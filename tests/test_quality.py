from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from martlib.operators import aggregates as A
from martlib.operators import clean as P
from martlib.operators import quality as Q
from tests.conftest import rows


def test_checks_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z")], "k int, v string")
    got = {r["check_name"]: (r["passed"], r["observed"]) for r in Q.run_checks(df, [Q.not_null("k"), Q.unique("k"), Q.accepted_values("v", ["a", "b"]), Q.in_range("k", 1, 5), Q.holds("null fails", F.col("k") > 0)]).collect()}
    assert got == {"k is not null": (False, 1.0), "k is unique": (False, 1.0), "v has accepted values": (False, 1.0), "k in range": (True, 0.0), "null fails": (False, 1.0)}


def test_severity(spark):
    df = spark.createDataFrame([(1,)], "k int")
    warn = Q.run_checks(df, [Q.holds("never", F.lit(False), severity="warn")])
    assert Q.require(warn).count() == 1
    with pytest.raises(Q.ChecksFailed, match="never"):
        Q.require(Q.run_checks(df, [Q.holds("never", F.lit(False))]))


def test_references_and_sums(spark):
    child = spark.createDataFrame([(1, 10), (2, 5), (None, 1)], "p int, v int")
    assert rows(Q.orphans(child, spark.createDataFrame([(1,)], "id int"), "p", "id"), "p") == [(2,)]
    assert Q.sums_match(child, "v", child, "v", "same").first()["passed"]
    assert not Q.sum_equals_rows(child, "v", child, "rows").first()["passed"]
    assert rows(Q.unique_combination(child.union(child), ["p", "v"]), "p") == [(None,), (1,), (2,)]


def test_contract(spark):
    df = spark.range(1)
    assert Q.enforce_contract(df, "id bigint") is df
    for bad in ("id int", "id bigint, x int", "ID bigint"):
        with pytest.raises(Q.ContractError):
            Q.enforce_contract(df, bad)


def test_domain_checks(spark):
    weather = spark.createDataFrame([("p", date(2024, 1, 1), 5.0, 1.0, None, 2.0), ("p", date(2024, 1, 2), 1.0, 5.0, -1.0, 2.0)], "city string, date date, temp_max double, temp_min double, precipitation double, wind_speed double")
    assert [r["observed"] for r in Q.run_checks(weather, Q.weather_checks()).collect()] == [1.0, 0.0, 1.0, 0.0]
    prices = spark.createDataFrame([("A", date(2024, 1, 5), 1.0, 2.0, 0.5, 1.5, 10), ("A", date(2024, 1, 6), 3.0, 2.0, 0.5, 4.0, -1)], "symbol string, trade_date date, open double, high double, low double, close double, volume long")
    assert [r["observed"] for r in Q.run_checks(prices, Q.price_checks()).collect()] == [0.0, 1.0, 1.0]
    assert [r["observed"] for r in Q.price_table_checks(prices, "2024-01-05").collect()] == [1.0, 1.0, 1.0]
    status = spark.createDataFrame([(i, 1, 1) for i in range(10)], "station_id int, bikes int, docks int")
    info = spark.createDataFrame([(i, 1) for i in range(9)], "station_id int, capacity int")
    assert [r["passed"] for r in Q.feed_completeness(status, info, "station_id", 10).collect()] == [True, False]
    assert Q.over_capacity(status, info, "station_id").first()["passed"]
    snaps = status.withColumn("taken_at", F.lit(datetime(2024, 1, 1, 10)))
    assert [r["passed"] for r in Q.monitoring_checks(snaps, "taken_at", "2024-01-01 10:30:00", 10).collect()] == [True, False]
    ages = Q.run_checks(snaps, Q.fresh("taken_at", "2024-01-01 12:00:00", 1, 3))
    assert [r["passed"] for r in ages.collect()] == [False, True]
    assert not Q.run_checks(snaps.limit(0), Q.fresh("taken_at", "2024-01-01 12:00:00", 1, 3)).first()["passed"]


def test_campaign(spark):
    data = [(30, 1, 999, "yes", date(2008, 6, 1), 6), (10, 0, 3, "maybe", date(2012, 6, 1), None)]
    df = spark.createDataFrame(data, "age int, campaign int, pdays int, y string, contact_month date, month_num int")
    assert [r["violations"] for r in A.rule_counts(df, Q.campaign_rules()).collect()] == [1, 1, 1, 1, 1]
    assert rows(P.campaign_features(df), "age_band", "days_since_previous", "previously_contacted", "converted") == [("18-24", 3, True, False), ("25-34", None, False, True)]


def test_event_parsing(spark):
    good = '{"event_id": "1", "event_time": "2024-01-01T10:00:00", "user_id": "u", "session_id": "s", "event_type": "purchase", "page": "/", "product_id": "P1", "price": 2.5}'
    texts = [good, good, "not json", good.replace("purchase", "dance"), good.replace("2024-01-01T10", "nope"), good.replace('"P1"', "null"), good.replace('"1"', "null"), good.replace("purchase", "product_view").replace('"P1"', "null").replace('"1"', '"2"')]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    valid, bad = P.parse_events(df)
    assert rows(valid, "event_id", "event_type") == [("1", "purchase"), ("2", "product_view")]
    assert rows(bad, "reject_reason") == [("bad event_time",), ("cart/purchase without product",), ("unknown event_type",), ("unparseable or no event_id",), ("unparseable or no event_id",)]
    assert P.widen_schema(spark.createDataFrame([('{"device": "x", "event_id": "1"}',)], "value string")).fieldNames()[-1] == "device"
