"""The curve, the laws of sharding, and what shards let a reader skip."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlib.llm import sharding as S
from martlib.llm.common import read
from tests.llm.conftest import tables


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 3), (3, 2), (4, 2), (1, 4)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = S.hilbert_index(list(points.T), bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def checked(spark, df, shards, law):
    got = [r.asDict() for r in S.shard_documents(df, shards, law).collect()]
    assert len(got) == df.count()
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    size = lambda r: len((r["text"] or "").encode()) + S.ROW_BYTES
    counts, sizes = ([sum(f(r) for r in got if r["shard"] == s) for s in range(shards)] for f in (lambda r: 1, size))
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    elif got:
        assert max(abs(x - sum(sizes) / shards) for x in sizes) <= max(map(size, got))
    return got


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws(spark, odd, none, law):
    """Null, empty and very long texts, repeats, ties, no id; a hot source; fewer rows than shards; columns of every name; no rows."""
    named = odd.selectExpr("*", "1 AS shard", "2 AS Slot", "3 AS __part", "4 AS at", "5 AS tie0", "6 AS row", "7 AS size", "8 AS doc")
    got = checked(spark, named, 24, law)
    assert all((r["__part"], r["at"], r["tie0"], r["row"], r["size"], r["doc"]) == (3, 4, 5, 6, 7, 8) and "Slot" not in r for r in got)
    checked(spark, odd, 5, law)
    hot = spark.range(400).selectExpr("id AS doc_id", "repeat('a', cast(id % 7 as int)) AS text", "'en' AS lang", "if(id % 3 = 0, cast(id as string), 'hot') AS source", "id AS n_chars")
    checked(spark, hot.unionByName(hot.where("doc_id < 50")), 24, law)
    checked(spark, none, 3, law)


def test_unknown_law(spark, odd):
    with pytest.raises(ValueError, match="no such law"):
        S.shard_documents(odd, 3, "key")


def test_shares_follow_rows(spark):
    """A value's cell is the share of rows with smaller values; ids at both ends of a long have cells too."""
    df = spark.createDataFrame([("b",)] * 6 + [("a",)] * 2 + [("c",)] + [("d",)] * 7, "v string")
    cell = {r["v"]: r["c"] for r in df.select("v", S.share_cells(df, F.col("v"), 16).alias("c")).collect()}
    assert cell == {"a": 0, "b": 2, "c": 8, "d": 9}
    ends = spark.createDataFrame([(-(2**63),), (0,), (2**63 - 1,)], "v long")
    assert [r["c"] for r in ends.select(S.step_cells(ends, F.col("v"), 16).alias("c")).collect()] == [0, 8, 15]


def test_query_columns(spark, odd, tmp_path):
    d = tables(spark, tmp_path, documents=odd.withColumn("extra", F.lit(1)))
    got = S.op13_sharding(spark, d).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((r["doc_id"] or 0, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_readers_skip_shards(spark, tmp_path):
    """Filters on any one dimension leave part of the 24 shards: one is skipped if its least and greatest values exclude the filter."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    S.write_shards(S.shard_documents(docs).withColumn("bytes", F.octet_length("text")), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == docs.count()
    spans = back.groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "bytes") for n, f in (("low", F.min), ("high", F.max))])
    long_ = docs.select(F.octet_length("text").alias("b")).approxQuantile("b", [0.9], 0.0)[0]
    kept = {c: spans.where(f"'{v}' BETWEEN low_{c} AND high_{c}").count() for c, v in (("lang", docs.agg(F.max("lang")).first()[0]), ("source", docs.agg(F.max("source")).first()[0]))}
    kept["bytes"] = spans.where(f"high_bytes >= {long_}").count()
    assert all(n <= 16 for n in kept.values()) and sum(kept.values()) <= 36, kept

