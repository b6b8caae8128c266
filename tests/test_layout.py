"""Clustered tables and files known by their content."""

import pytest
from pyspark.sql import functions as F

from martlib.plans import flows
from martlib.sources.layout import ClusteredTable, even_cuts
from tests.conftest import rows


def test_clustered_table(spark, tmp_path, monkeypatch):
    """Ranges of either column read few files and lose no row; nulls; an append; a rewrite that stops changes nothing."""
    df = spark.range(4000).select((F.col("id") % 63).alias("x"), F.when(F.col("id") % 50 > 0, (F.col("id") * 37 % 101).cast("double")).alias("y"), "id")
    t = ClusteredTable(spark, str(tmp_path / "t"), ["x", "y"])
    t.write(df, 16)
    for ranges, test in (({"x": (10, 12)}, "x BETWEEN 10 AND 12"), ({"y": (None, 9.0)}, "y <= 9"), ({"x": (60, None), "y": (50.0, 60.0)}, "x >= 60 AND y BETWEEN 50 AND 60"), ({"x": (99, 100)}, "x = 99")):
        files, every = t.picked(ranges)
        assert len(files) <= every / 2
        assert rows(t.read(ranges)) == rows(df.where(test))
    t.append(spark.createDataFrame([(1, 2.0, -1)], "x long, y double, id long"), 16)
    assert rows(t.read({"x": (1, 1), "y": (2.0, 2.0)}).where("id < 0"), "id") == [(-1,)]
    before = rows(t.all())
    with monkeypatch.context() as m:
        m.setattr(t.tables, "publish", lambda run: (_ for _ in ()).throw(RuntimeError("the machine went away")))
        with pytest.raises(RuntimeError):
            t.write(df.limit(3), 2)
    assert rows(t.all()) == before
    t.compact(4)
    assert rows(t.all()) == before and t.picked({})[1] == 4


def test_files_end_where_classes_do(spark, tmp_path):
    """A quarter of one column's values and a few more, as values are not dealt evenly, lies in half of the files at most."""
    df = spark.range(40000).select(F.pmod(F.xxhash64("id"), F.lit(2500)).alias("x"), F.pmod(F.xxhash64(-F.col("id")), F.lit(20000)).alias("y"))
    t = ClusteredTable(spark, str(tmp_path / "t"), ["x", "y"])
    t.write(df, 32)
    for ranges, test in (({"y": (20, 5200)}, "y BETWEEN 20 AND 5200"), ({"x": (None, 650)}, "x <= 650")):
        files, every = t.picked(ranges)
        assert every == 32 and len(files) <= 16
        assert t.read(ranges).count() == df.where(test).count()


def test_even_cuts():
    assert even_cuts([(c, 10) for c in range(16)], 4) == [3, 7, 11]
    assert even_cuts([(c, 9 if c < 8 else 11) for c in range(16)], 2) == [7]
    assert even_cuts([(0, 10), (1, 1000), (2, 10)], 4) is None and even_cuts([], 2) is None
    assert even_cuts([(5, 3)], 1) == []


def test_ledger_by_content(spark, tmp_path, monkeypatch):
    land, lake = tmp_path / "in", str(tmp_path / "lake")
    land.mkdir()
    (land / "a.txt").write_text("one\n\ntwo\n")
    (land / "b.txt").write_text("one\n\ntwo\n")
    with monkeypatch.context() as m:  # lines are written, and the run stops before its ledger
        m.setattr(flows, "_fs", lambda s, p, whole=flows._fs: whole(s, p))
        m.setattr("pyspark.sql.readwriter.DataFrameWriter.mode", lambda self, mode, whole=type(spark.range(1).write).mode: (_ for _ in ()).throw(RuntimeError("gone")) if mode == "append" else whole(self, mode))
        with pytest.raises(RuntimeError):
            flows.ingest_by_content(spark, str(land), lake)
    assert flows.ingest_by_content(spark, str(land), lake) == {"files": 1, "lines": 2}
    assert flows.ingest_by_content(spark, str(land), lake) == {"files": 0, "lines": 0}
    (land / "c.txt").write_text("one\n\ntwo\n")
    (land / "a.txt").write_text("changed\n")
    assert flows.ingest_by_content(spark, str(land), lake) == {"files": 1, "lines": 1}
    assert rows(spark.read.parquet(f"{lake}/bronze"), "value") == [("changed",), ("one",), ("two",)]
