"""What the corpus operators share: reading tables, passing texts through Arrow in small slices, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one Arrow batch, and UTF-8 bytes of their texts, that are Python objects at the same time (one row at least).
SLICE_ROWS, SLICE_BYTES = 256, 1_000_000
#: Rows of an Arrow batch. Spark holds a batch outside its heap several times over, and texts are wide.
BATCH_ROWS = 512
#: Rows of a file of links, which hold two or three numbers a row, and of a file of wider rows.
FILE_ROWS, WIDE_ROWS = 1_000_000, 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def own_prefix(columns: list[str]) -> str:
    """A prefix that no column has (names compare as Spark does, case apart)."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that a result of that name is about to replace (names compare as Spark does, case apart)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows at most; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile has Arrow batches of so many rows at most, for rows that are wider than texts."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of the parts in which a batch is handled."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        most = (ends[at - 1] if at else 0) + SLICE_BYTES
        stop = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, most, side="right"))))
        yield at, stop - at
        at = stop


def map_texts(df: DataFrame, text: str, added: list[T.StructField], make: Callable[[], Callable[[list], list[list]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns that depend on one text column, row by row, without a shuffle.

    make() runs once in each task and returns a function from a list of texts (None for null) to one list for each added
    column. Every other column passes through unchanged, nulls included; an input column with the name of an added one is
    replaced. Columns named in drop are read but not returned. Rows are handled a slice at a time, so memory follows SLICE_BYTES.
    """
    small_batches(df.sparkSession)
    new = [f.name for f in added]
    if text.lower() in {n.lower() for n in new}:
        copy = own_prefix(df.columns) + "text"
        source, text = df.withColumn(copy, F.col(f"`{text}`")), copy
        drop = (*drop, copy)
    else:
        source = df
    source = without(source, new)
    kept = [f for f in source.schema.fields if f.name not in drop]
    types = [to_arrow_type(f.dataType) for f in added]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at, n in slices(batch.column(text)):
                part = batch.slice(at, n)
                columns = work(part.column(text).to_pylist())
                made = [pa.array(values, type=kind) for values, kind in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *made], names=[*names, *new])
        pa.default_memory_pool().release_unused()  # the worker lives on, and others start beside it

    return source.mapInArrow(run, T.StructType([*kept, *added]))


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


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/martlib-{spark.sparkContext.applicationId}"


def _scratch_fs(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame, label: str, rows: int | None = None, wide: bool = False) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation.

    rows: how many there are at most, or about, where the caller has counted them; they then go to few files. wide: rows are not
    just links, and work is left to be done on them, so there are as many files as tasks can run, or more. The folder goes
    when the application ends, or before with drop_scratch().
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, 1 + rows // WIDE_ROWS) if wide else 1 + rows // FILE_ROWS)
    df.write.option("compression", "zstd").parquet(path)
    fs, scratch = _scratch_fs(spark)
    fs.deleteOnExit(scratch)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """df written to the shared folder in buckets of key and read back: joins by key of tables with as many buckets need no
    shuffle. Bucketing needs a name in the catalog, which is there while the table is opened only."""
    spark = df.sparkSession
    name = f"martlib_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{_scratch(spark)}/{name}").option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    fs, scratch = _scratch_fs(spark)
    fs.deleteOnExit(scratch)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def drop_scratch(spark: SparkSession) -> None:
    """Delete what materialize() has written in this application."""
    fs, path = _scratch_fs(spark)
    fs.delete(path, True)
