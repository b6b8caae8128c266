import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from martlib.sources import lake, readers, writers
from tests.conftest import rows


def test_read_unified(spark, tmp_path):
    spark.createDataFrame([(1, "2.5")], "ID int, Fare string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2.0, 3.5)], "id double, fare double").write.parquet(str(tmp_path / "b"))
    got = readers.read_unified(spark, [str(tmp_path / "a"), str(tmp_path / "b")], {"id": "bigint", "fare": "double"})
    assert got.dtypes == [("id", "bigint"), ("fare", "double")] and rows(got) == [(1, 2.5), (2, 3.5)]
    with pytest.raises(ValueError, match="missing"):
        readers.read_unified(spark, [str(tmp_path / "a")], {"other": "int"})


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;x\n2; \n")
    assert rows(readers.read_csv_typed(spark, str(tmp_path / "a.csv"), "a int, b string", ";"), "a") == [(1,), (2,)]
    (tmp_path / "b.csv").write_text("a,b\n1,x\nno,\n")
    assert rows(readers.read_csv_strings(spark, str(tmp_path / "b.csv"), ["a", "b"], {"a": "int"})) == [(None, None), (1, "x")]


def test_lines(spark, tmp_path):
    (tmp_path / "2024-01-05").mkdir()
    (tmp_path / "2024-01-05/x.jsonl").write_text("one\n\n two \n")
    assert rows(readers.read_lines_with_lineage(spark, str(tmp_path)), "value", "_landing_date") == [(" two ", date(2024, 1, 5)), ("one", date(2024, 1, 5))]


def test_weather(spark, tmp_path):
    daily = {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [5.0, None], "temperature_2m_min": [1.0, 2.0], "precipitation_sum": [0.0, 1.0], "wind_speed_10m_max": [3.0, 4.0]}
    (tmp_path / "ok.json").write_text(json.dumps({"city": "Paris", "daily": daily}))
    assert rows(readers.read_weather(spark, str(tmp_path / "ok.json")), "date", "temp_max") == [(date(2024, 1, 1), 5.0), (date(2024, 1, 2), None)]
    for broken in ({**daily, "precipitation_sum": [0.0]}, {k: v for k, v in daily.items() if k != "precipitation_sum"}):
        (tmp_path / "bad.json").write_text(json.dumps({"city": "Paris", "daily": broken}))
        with pytest.raises(Exception, match="missing or differ"):
            readers.read_weather(spark, str(tmp_path / "bad.json")).collect()


def chart(**change):
    quote = {"open": [1.00005, None], "high": [2.0, 2.0], "low": [0.5, 0.5], "close": [1.5, 1.5], "volume": [10, 20]}
    result = {"meta": {"exchangeTimezoneName": "America/New_York"}, "timestamp": [1735828200, 1735914600], "indicators": {"quote": [quote], "adjclose": []}}
    return json.dumps({"symbol": "A", "chart": {"error": None, "result": [result]} | change})


def test_prices(spark, tmp_path):
    read = lambda text: readers.explode_price_bars(spark.read.schema(readers.PRICE_CHART).json(spark.sparkContext.parallelize([text])))
    got = read(chart()).collect()
    assert len(got) == 1 and got[0]["trade_date"] == date(2025, 1, 2) and str(got[0]["open"]) == "1.0001" and got[0]["adj_close"] == got[0]["close"]
    for bad in ({"error": "Not found"}, {"result": []}):
        with pytest.raises(Exception, match="A: "):
            read(chart(**bad)).collect()
    twice = chart().replace("1735914600", "1735828260").replace("null], \"high\"", "1.0], \"high\"")
    with pytest.raises(Exception, match="duplicate"):
        read(twice).collect()


def test_stations(spark, tmp_path):
    station = {"station_id": 1, "stationCode": "16107", "num_bikes_available_types": [{"mechanical": 2}, {"ebike": 1}], "num_docks_available": 3, "is_installed": 1, "is_renting": 1, "is_returning": 0, "last_reported": 1700000000}
    bare = {"station_id": 2, "stationCode": "x", "is_installed": 1}
    snap = {"taken_at": "2024-01-01T10:00:00Z", "status": {"data": {"stations": [station, bare]}}, "information": {"data": {"stations": [{"station_id": 1, "stationCode": "16107", "name": "n", "lat": 1.0, "lon": 2.0}]}}}
    (tmp_path / "date=2024-01-01").mkdir()
    with gzip.open(tmp_path / "date=2024-01-01/s1.json.gz", "wt") as f:
        json.dump(snap, f)
    docs = readers.read_gz_snapshots(spark, str(tmp_path))
    assert rows(readers.flatten_station_status(docs), "snapshot_id", "station_id", "mechanical", "ebike", "docks", "is_renting", "is_returning") == [("s1", 1, 2, 1, 3, True, False), ("s1", 2, 0, 0, 0, False, False)]
    assert rows(readers.flatten_station_info(docs), "station_id", "capacity") == [(1, 0)]
    from martlib.operators.clean import stage_station_status, stage_stations, station_flags

    coded = spark.createDataFrame([("16107",), ("1001",), ("60001",), ("21001",), ("x1",)], "station_code string")
    assert rows(stage_stations(coded), "station_code", "area", "arrondissement") == [("1001", "1er", 1), ("16107", "16e", 16), ("21001", "Suburbs", None), ("60001", "Event stations", None), ("x1", "Suburbs", None)]
    flags = station_flags(stage_station_status(readers.flatten_station_status(docs)))
    assert rows(flags, "station_id", "fill_pct", "is_empty", "is_full", "is_operating") == [(1, 50.0, False, False, False), (2, None, False, False, False)]


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    writers.overwrite_partitions(df, path, ["p"])
    writers.overwrite_partitions(df.where("p = 'b'").withColumn("v", F.lit(9)), path, ["p"])
    assert rows(spark.read.parquet(path), "v", "p") == [(1, "a"), (9, "b")]
    writers.one_file_per_partition(df.repartition(4), path, "p")
    assert len(list((tmp_path / "t/p=a").glob("*.parquet"))) == 1
    writers.sorted_partition_write(df, path, ["p"], ["v"])
    writers.compact_partitions(spark, path, ["p"], "v", 1)
    assert rows(spark.read.parquet(path), "v", "p") == [(1, "a"), (2, "b")]
    for _ in range(2):
        writers.quarantine(df, str(tmp_path / "q"), "b1")
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    writers.full_reload(df.limit(1), str(tmp_path / "f"))
    writers.full_reload(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    writers.save_result_csv(df, str(tmp_path.parent / "result_csv"))
    writers.append_bronze(df.withColumn("_landing_date", F.lit(date(2024, 1, 1))), str(tmp_path / "b"))
    writers.force_compute(df)
    checks = spark.createDataFrame([("x", "warn", False, 1.0), ("y", "warn", True, 0.0)], "check_name string, severity string, passed boolean, observed double")
    writers.write_alerts(checks, str(tmp_path / "alerts"), "r1")
    assert rows(spark.read.parquet(str(tmp_path / "alerts")), "check_name") == [("x",)]
    inventory = lake.register_lake(spark, str(tmp_path))
    assert ("t", "p", "string", True, 2) in rows(inventory) and spark.sql("SELECT count(*) FROM t").first()[0] == 2
    got = readers.run_named_queries(spark, "-- name: one\nSELECT sum(v) AS s FROM t;\n-- name: two\nSELECT 2 AS two\n")
    assert got["one"].first()["s"] == 3 and got["two"].first()["two"] == 2
    assert rows(lake.serve(spark.table("t"), "v > 0", [F.desc("v")], 1), "v") == [(2,)]


def test_publish_and_state(spark, tmp_path):
    p = writers.Publisher(spark, str(tmp_path / "pub"))
    assert p.read("t") is None
    p.write("r1", "t", spark.range(2))
    assert p.current() is None
    p.publish("r1")
    p.write("r2", "t", spark.range(5))
    assert p.read("t").count() == 2
    p.publish("r2")
    assert p.read("t").count() == 5
    s = writers.State(spark, str(tmp_path / "state"))
    assert s.get("x") is None
    s.set("x", 1)
    s.set("x", 4)
    assert s.get("x") == 4 and readers.changes_since(spark.range(6), "id", s.get("x")).count() == 1


def test_files(spark, tmp_path):
    for name in ("2024-01_delivered-2024-02-01.txt", "2024-01_delivered-2024-03-01.txt", "2024-02_delivered-2024-03-01.txt"):
        (tmp_path / name).write_text("x")
    files = readers.list_files(spark, str(tmp_path))
    got = readers.latest_delivery(files, r"(\d{4}-\d{2})_delivered", r"delivered-(\d{4}-\d{2}-\d{2})")
    assert rows(got, "period", "delivered") == [("2024-01", "2024-03-01"), ("2024-02", "2024-03-01")]
    assert readers.new_files(files, files.limit(1)).count() == 2 and readers.new_files(files, files).count() == 0


def test_compaction_that_was_cut_short(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "v long, p string")
    writers.overwrite_partitions(df.repartition(4), path, ["p"])
    df.write.partitionBy("p").parquet(f"{path}_compact")  # complete aside, and half of the live table is gone
    writers._delete(spark, f"{path}/p=a")
    writers.compact_partitions(spark, path, ["p"], "v", 1)
    assert rows(spark.read.parquet(path), "v", "p") == rows(df) and not (tmp_path / "t_compact").exists()


def test_compaction_keeps_what_was_appended_after_a_crash(spark, tmp_path, monkeypatch):
    """A run that stops before any file moves, one that stops half way, appends in between, and a value with odd characters."""
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, ["a b", "c:d%"][i % 2]) for i in range(20)], "v long, p string")
    df.repartition(4).write.partitionBy("p").parquet(path)
    more = lambda start: spark.range(start, start + 5).selectExpr("id AS v", "'a b' AS p")
    for start, broken in ((100, "_move_files"), (200, "_delete")):
        with monkeypatch.context() as m:
            m.setattr(writers, broken, lambda *a: (_ for _ in ()).throw(RuntimeError("the machine went away")))
            with pytest.raises(RuntimeError):
                writers.compact_partitions(spark, path, ["p"], "v", 1)
        more(start).write.mode("append").partitionBy("p").parquet(path)
        df = df.unionByName(more(start))
        writers.compact_partitions(spark, path, ["p"], "v", 1)
        assert rows(spark.read.parquet(path), "v", "p") == rows(df, "v", "p")
    writers.compact_partitions(spark, path, ["p"], "v", 1)
    assert rows(spark.read.parquet(path), "v", "p") == rows(df, "v", "p") and sum(1 for _ in (tmp_path / "t").rglob("*.parquet")) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_compaction_gives_each_partition_a_task(spark, tmp_path, monkeypatch):
    """One file for each partition, and no task that gets the whole table; a null value is a partition, too."""
    path, tasks = str(tmp_path / "t"), []
    df = spark.createDataFrame([(i, [2001, 2002, 2003, None][i % 4]) for i in range(40)], "v long, y int")
    df.repartition(4).write.partitionBy("y").parquet(path)
    whole = writers._move_files
    seen = lambda s, source, *more: tasks.extend(p.name.split("-")[1] for p in (tmp_path / "t_compact").rglob("part-*.parquet")) or whole(s, source, *more)
    monkeypatch.setattr(writers, "_move_files", seen)
    writers.compact_partitions(spark, path, ["y"], "v", 1)
    assert rows(spark.read.parquet(path), "v", "y") == rows(df, "v", "y")
    assert len(tasks) == 4 and len(set(tasks)) == 4


def test_shared_folder_has_to_be_named_on_a_cluster(spark, monkeypatch):
    from martlib.sources import scratch

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)
