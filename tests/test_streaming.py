import json

from pyspark.sql import functions as F

from martlib.streaming import clicks
from tests.conftest import rows

PRODUCTS = ["P1", "P2"]


def event(i, minute=0, kind="purchase", **change):
    return json.dumps({"event_id": str(i), "event_time": f"2024-01-01T10:{minute:02d}:30", "user_id": "u", "session_id": "s", "event_type": kind, "page": "/", "product_id": "P1", "price": 2.5} | change)


def test_sink_gives_the_same_result_under_replay(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    (land / "a.jsonl").write_text("\n".join([event(1), event(1), event(2, 1, "page_view", product_id=None), "broken", event(3, kind="dance"), event(4, product_id="P9"), event(5, user_id="")]))
    sink = clicks.ClickSink(spark, str(tmp_path / "out"))
    run = lambda: sink.start(clicks.read_clicks_stream(spark, {"path": str(land)}), PRODUCTS, str(tmp_path / "ck")).awaitTermination()
    run()
    assert rows(sink.events(), "event_id") == [("1",), ("2",)]
    assert rows(sink.dead_letters(), "reject_reason") == [("missing fields",), ("not a JSON object",), ("unknown event_type",), ("unknown product",)]
    assert rows(sink.stats(), "received", "inserted", "invalid", "duplicates") == [(7, 2, 4, 1)]
    before = rows(sink.minute_counts(), "event_type", "events", "revenue")
    assert before == [("page_view", 1, None), ("purchase", 1, 2.5)]
    run()
    tagged = clicks.validate(spark.read.text(str(land / "a.jsonl")), PRODUCTS)
    sink.write_batch(tagged, 0)
    assert rows(sink.minute_counts(), "event_type", "events", "revenue") == before and sink.events().count() == 2
    (land / "b.jsonl").write_text("\n".join([event(1), event(6)]))
    run()
    assert rows(sink.events(), "event_id") == [("1",), ("2",), ("6",)]
    assert dict((r[0], r[1]) for r in rows(sink.minute_counts(), "event_type", "events")) == {"page_view": 1, "purchase": 2}


def test_batch_forms(spark):
    df = spark.createDataFrame([(event(1),), (event(2, 1),)], "value string")
    e = clicks.events_of(clicks.validate(df, PRODUCTS))
    assert clicks.minute_counts(e).count() == 2
    assert clicks.in_user_order(e, "user_id", "event_time").count() == 2
    assert clicks.with_lateness(e, "event_time", "15 minutes").where(F.col("event_id") == "1").count() == 1
