"""Tables that an operator writes for itself: lineage ends there, and what is in them stays as it is if an executor is lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlib.functions import columns as C


#: Folders of operators' own tables, by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. A session that names none gets a folder of
    its own where all of Spark is one process; on a cluster that would be a different disk on each machine, so it fails."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder that nothing else uses; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def drop(spark: SparkSession) -> None:
    """Delete what operators have written for themselves in this application; what reads it is of no use then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    folder = new_folder(df.sparkSession, label)
    _made.setdefault(df.sparkSession.sparkContext.applicationId, []).append(folder)
    path = f"{folder}/t"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list[Column | str], label: str = "ranges") -> DataFrame:
    """df dealt to ranges by an order: __part numbers the ranges, __at the rows within one, from 0. Written to the shared folder,
    so that both stay as they are whatever is read again. The order must be unique, or ties fall anyhow."""
    keys = [C.col(c) for c in order]
    ranged = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*keys)
    return materialize(ranged.withColumn("__at", F.monotonically_increasing_id() % F.lit(1 << 33)), label)


def range_starts(ranged: DataFrame, size: Column) -> DataFrame:
    """(__part, __start): what all ranges before a range hold; size: an aggregate of one range. A row for each range."""
    sizes = ranged.groupBy("__part").agg(size.alias("n"))
    return sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
