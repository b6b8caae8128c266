"""The lake's tables as views, with an inventory, and the bounded queries that serve marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.sources.writers import _fs


def register_lake(spark: SparkSession, root: str) -> DataFrame:
    """Make every folder or Parquet file below root a view by its name. Returns (table, column, type, is_partition, partitions)."""
    fs, p = _fs(spark, root)
    rows = []
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
        name = s.getPath().getName()
        if name.startswith(("_", ".")) or not (s.isDirectory() or name.endswith(".parquet")):
            continue
        df = spark.read.parquet(s.getPath().toString())
        name = name.removesuffix(".parquet")
        df.createOrReplaceTempView(name)
        parts = [c.getPath().getName() for c in fs.listStatus(s.getPath()) if "=" in c.getPath().getName()] if s.isDirectory() else []
        keys = {x.split("=")[0] for x in parts}
        rows += [(name, f.name, f.dataType.simpleString(), f.name in keys, len(parts)) for f in df.schema]
    return spark.createDataFrame(rows, "table string, column string, type string, is_partition boolean, partitions int")


def serve(mart: DataFrame, where: str | None = None, order: list | None = None, n: int | None = None) -> DataFrame:
    """A filtered, ordered and bounded look at a mart (top-k, so no full sort is needed for n rows)."""
    out = mart.where(where) if where else mart
    out = out.orderBy(*order) if order else out
    return out.limit(n) if n else out


def area_hour_grid(mart: DataFrame, value: str) -> DataFrame:
    """Areas down, hours across."""
    return mart.groupBy("area").pivot("hour", list(range(24))).agg(F.first(value)).orderBy("area")
