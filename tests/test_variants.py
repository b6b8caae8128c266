"""Texts parsed to VARIANT: which fields there are, of what types, over batches that do not agree."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.operators import clean as P
from martlib.operators import variants as V
from martlib.plans import flows

from .conftest import rows
from .test_flows import event

BIG, TEXT, NUMBER, EMPTY = T.LongType(), T.StringType(), T.DoubleType(), T.NullType()


def shape(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    return V.as_fields(df.agg(V.field_types(V.parse_object()).alias("s")).first()["s"])


def test_fields_of_texts(spark):
    found = shape(spark, '{"a": 1, "b": {"c": "x", "OBJECT<": [1, 2]}}', ' \n{"a": "t", "n": null}', "[1]", "nope", "3", None, '{"a": 1, "a": 2}')
    assert {f.name: f.dataType.simpleString() for f in found.fields} == {"a": "variant", "b": "struct<OBJECT<:array<bigint>,c:string>", "n": "void"}
    assert shape(spark, "nope", None, "[1]") == shape(spark) == shape(spark, "{}") == T.StructType()
    with pytest.raises(ValueError, match="more than 2 fields"):
        V.as_fields("OBJECT<a: BIGINT, b: BIGINT, c: BIGINT>", 2)


def test_types_of_batches_are_merged():
    pairs = [(BIG, BIG, BIG), (EMPTY, TEXT, TEXT), (BIG, NUMBER, NUMBER), (BIG, TEXT, T.VariantType()), (BIG, T.DecimalType(3, 1), T.DecimalType(20, 1)),
             (T.DecimalType(30, 0), T.DecimalType(20, 19), NUMBER), (T.ArrayType(EMPTY), T.ArrayType(BIG), T.ArrayType(BIG)), (T.ArrayType(BIG), BIG, T.VariantType())]
    for a, b, both in pairs:
        assert V.merge_types(a, b) == V.merge_types(b, a) == both
    one, two = T.StructType().add("x", BIG).add("y", TEXT), T.StructType().add("y", BIG).add("z", TEXT)
    assert V.merge_fields([one, two]) == V.merge_fields([two, one]) == T.StructType().add("x", BIG).add("y", T.VariantType()).add("z", TEXT)
    assert V.merge_fields([]) == T.StructType()


def test_merge_is_what_one_batch_would_say(spark):
    """Texts in two batches have the types that Spark finds in both together."""
    texts = ['{"a": 1, "b": {"c": 1}, "d": [1]}', '{"a": 2.5, "b": {"c": "x", "e": true}, "d": [null]}', '{"a": null, "d": "x"}', '{"a": 1e300, "f": {"g": []}}', '{"f": {"g": [{"h": 1}]}}', "{}"]
    for cut in range(len(texts) + 1):
        assert V.merge_fields([shape(spark, *texts[:cut]), shape(spark, *texts[cut:])]) == V.merge_fields([shape(spark, *texts)])


def test_names_that_meet():
    assert V.column_names(["b", "Device", "device", "BATCH", "", "z_field"], ["batch", "x"]) == {"_field": [""], "BATCH_field": ["BATCH"], "Device": ["Device", "device"], "b": ["b"], "z_field": ["z_field"]}


def test_fields_with_any_name(spark):
    names = ["a.b", "it's", 'say "x"', "both ' and \"", "ü", "a`b", "$", "d e"]
    df = spark.createDataFrame([(json.dumps({n: i for i, n in enumerate(names)}),)], "value string").withColumn("v", V.parse_object())
    taken = df.select(*V.take_fields("v", V.column_names(names, [])))
    assert taken.first().asDict() == {n: str(i) for i, n in enumerate(names)}
    assert V.typed(taken, shape(spark, df.first()["value"])).first().asDict() == {n: i for i, n in enumerate(names)}


def test_events_equal_those_of_a_fixed_schema(spark):
    good = json.loads(event(1, "2024-01-01", "purchase"))
    odd = [None, "", 5, 2.5, True, {"a": 1}, [1], "2024-01-01T10:00:00", "purchase", "x" * 5000]
    texts = [json.dumps(good | {k: v}) for k in good for v in odd] + [json.dumps({k: v for k, v in good.items() if k != gone}) for gone in good]
    texts += ["", "{", "[]", "null", "nope", "{}", json.dumps([good]), " " + json.dumps(good), None]
    # an id for each text, or the pick among repeated ids would differ
    texts = [t if not t or '"event_id": "1"' not in t else t.replace('"event_id": "1"', f'"event_id": "{i}"') for i, t in enumerate(texts)]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    plain = P.parse_events(df)
    parsed = P.judge_events(df.withColumn("v", V.parse_object()).select("value", P.event_struct("v", {}).alias("e")), P.EVENT_SCHEMA.fieldNames())
    same_price = [c for c in plain[0].columns if c != "price"]
    assert rows(plain[0], *same_price) == rows(parsed[0], *same_price)
    assert rows(plain[1]) == rows(parsed[1])


def test_medallion_with_fields_that_change(spark, tmp_path):
    land, day = tmp_path / "land", "2024-01-01"
    land.mkdir()
    m = flows.Medallion(spark, str(tmp_path / "lake"))
    assert m.events() is None and m.fields() == T.StructType()
    batches = [
        [event(1, day, "purchase", level=3, place={"x": 1}, device="phone", batch="theirs", Price="dear"), "broken"],
        [event(2, day, "purchase", level="high", place={"x": 2.5, "tag": "t"}, Device="tv", score=None)],
        [event(3, day, "purchase", place="home"), event(4, day, "page_view", score=[1, None])],
    ]
    for n, texts in enumerate(batches):
        (land / f"{n}.jsonl").write_text("\n".join(texts))
        m.run(str(land))
        if n == 1:
            assert rows(m.events(), "event_id", "place.x", "place.tag") == [("1", 1.0, None), ("2", 2.5, "t")]
    kinds = {f.name.lower(): f.dataType.simpleString() for f in m.fields().fields}
    assert kinds == {"device": "string", "level": "variant", "place": "variant", "batch_field": "string", "price_field": "string", "score": "array<bigint>"}
    assert rows(m.events(), "event_id", "level", "place", "device", "batch_field", "Price_field", "price") == [
        ("1", "3", '{"x":1}', "phone", "theirs", "dear", 2.0), ("2", "high", '{"tag":"t","x":2.5}', "tv", None, None, 2.0), ("3", None, "home", None, None, None, 2.0), ("4", None, None, None, None, None, 2.0)]
    assert m.events().where("event_id = '4'").select(F.to_json(F.struct("score"), {"ignoreNullFields": "false"})).first()[0] == '{"score":[1,null]}'
