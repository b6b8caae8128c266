"""Writers for partitioned Parquet. Each is safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, columns: list[str], **options: str) -> None:
    """Replace the partitions that df has rows for, and no others. df must not read path."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy(*columns).parquet(path)


def one_file_per_partition(df: DataFrame, path: str, column: str) -> None:
    overwrite_partitions(df.repartition(F.col(column)), path, [column])


def sorted_partition_write(df: DataFrame, path: str, columns: list[str], sort: list[str]) -> None:
    """Rows in order within each file, so that row groups can be skipped; zstd."""
    overwrite_partitions(df.sortWithinPartitions(*columns, *sort), path, columns, compression="zstd")


def append_bronze(df: DataFrame, path: str, column: str = "_landing_date") -> None:
    df.write.mode("append").partitionBy(column).parquet(path)


def full_reload(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def save_result_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def quarantine(rejected: DataFrame, path: str, batch_id: str) -> None:
    """Rejected rows with their reason, once for each batch: a batch that runs again replaces its own rows. New columns may
    come; read with mergeSchema."""
    overwrite_partitions(rejected.withColumn("batch_id", F.lit(batch_id)), path, ["batch_id"])


def write_alerts(checks: DataFrame, path: str, run_id: str) -> None:
    failed = checks.where("NOT passed").withColumn("run_id", F.lit(run_id))
    overwrite_partitions(failed, path, ["run_id"])


def force_compute(df: DataFrame) -> None:
    """Run the whole plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def compact_partitions(spark: SparkSession, path: str, columns: list[str], sort: str, files: int) -> None:
    """Rewrite partitions as few files, rows near each other by sort: a file for each partition if `files` is no more than there are
    partitions, each sorted by a task of its own, and else about `files` ranges of the whole table.

    The files to be replaced are listed, and the new ones are complete aside, before anything changes. Then these are moved into
    the table, and the listed files are deleted, no others: files that were appended meanwhile stay. A run that ends at any
    point is taken up by the next one where it stopped. Until then readers may see rows of both; none are lost. New files
    without a list, as an earlier form of this function could leave them, replace partitions that are gone, and no others.
    """
    aside, listed = f"{path}_compact", f"{path}_compact_inputs"
    if _done(spark, aside) and not _done(spark, listed):
        _move_files(spark, aside, path, columns[0])
        _delete(spark, aside)
    if not _done(spark, aside):
        table = spark.read.option("basePath", path)
        names = [_plain(spark, f) for f in spark.read.parquet(path).inputFiles()]
        if not names:
            return
        spark.createDataFrame([(n,) for n in names], "path string").coalesce(1).write.mode("overwrite").parquet(listed)
        rows = table.parquet(*names)
        values = rows.select(*columns).distinct().orderBy(*columns).collect()  # a row for each partition
        if files <= len(values):
            place = [F.struct(*[F.lit(v[c]).cast(rows.schema[c].dataType).alias(c) for c in columns]) for v in values]
            number = F.array_position(F.array(*place), F.struct(*columns)).cast("int") - 1
            spread = rows.repartitionById(len(values), number)
        else:
            spread = rows.repartitionByRange(files, *columns, sort)
        spread = spread.sortWithinPartitions(*columns, sort)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*columns).parquet(aside)
    _move_files(spark, aside, path)
    fs = _fs(spark, path)[0]
    for r in spark.read.parquet(listed).collect():  # a row for each file
        fs.delete(_fs(spark, r["path"])[1], False)
    _delete(spark, aside)  # first: a list alone is written anew
    _delete(spark, listed)


def _done(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _plain(spark: SparkSession, uri: str) -> str:
    """The path that a URI of a file stands for, its escapes undone."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()


def _move_files(spark: SparkSession, source: str, target: str, lacking: str | None = None) -> None:
    """Data files of one folder to the same places below another. lacking: a partition column; only files of its values that the
    target has no folder for."""
    fs, root = _fs(spark, source)
    base = fs.makeQualified(root).toString().rstrip("/")
    there = {s.getPath().getName() for s in fs.listStatus(_fs(spark, target)[1])}
    found, names = fs.listFiles(root, True), []
    while found.hasNext():
        p = found.next().getPath()
        place = p.toString().removeprefix(base)
        if not p.getName().startswith(("_", ".")) and not (lacking and place.split("/")[1] in there):
            names.append(p.toString())
    for name in names:
        _, place = _fs(spark, f"{target}{name.removeprefix(base)}")
        fs.mkdirs(place.getParent())
        fs.rename(_fs(spark, name)[1], place)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Publisher:
    """Several tables that change together: a run writes each under its own folder, and one small pointer switches readers.

    root/runs/<run>/<table> holds the data; the newest row of root/pointer names the run. A run that fails before publish()
    changes nothing that readers see.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, run: str, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/runs/{run}/{name}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path, compression="zstd")
        return self.spark.read.parquet(path)

    def publish(self, run: str) -> None:
        row = self.spark.createDataFrame([(run,)], "run string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")

    def clean(self, keep: int = 2) -> int:
        """Delete the folders of runs that are not among the last `keep` published ones, runs that failed included; how many. Not
        for use while a run is being written."""
        fs, runs = _fs(self.spark, f"{self.root}/runs")
        if not fs.exists(runs):
            return 0
        kept: set[str] = set()
        if _fs(self.spark, f"{self.root}/pointer")[0].exists(_fs(self.spark, f"{self.root}/pointer")[1]):
            kept = {r["run"] for r in self.spark.read.parquet(f"{self.root}/pointer").groupBy("run").agg(F.max("at").alias("at")).orderBy(F.desc("at")).limit(keep).collect()}
        old = [s.getPath() for s in fs.listStatus(runs) if s.getPath().getName() not in kept]
        for p in old:
            fs.delete(p, True)
        return len(old)

    def current(self) -> str | None:
        fs, p = _fs(self.spark, f"{self.root}/pointer")
        if not fs.exists(p):
            return None
        last = self.spark.read.parquet(f"{self.root}/pointer").agg(F.max_by("run", "at").alias("run")).first()
        return last["run"]

    def read(self, name: str) -> DataFrame | None:
        run = self.current()
        return None if run is None else self.spark.read.parquet(f"{self.root}/runs/{run}/{name}")


class ChangeLog:
    """Changes of a table by version, as merges return them. A version that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, changes: DataFrame) -> None:
        overwrite_partitions(changes.withColumn("version", F.lit(version)), self.path, ["version"])

    def read(self, after: int, upto: int) -> DataFrame:
        """Changes of the versions over `after`, up to `upto`: a consumer keeps the last version it has taken. Reads no others."""
        return self.spark.read.parquet(self.path).where((F.col("version") > after) & (F.col("version") <= upto))


class State:
    """Last processed version of each pipeline: rows (pipeline, version, at), newest wins."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, pipeline: str):
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return None
        got = self.spark.read.parquet(self.path).where(F.col("pipeline") == pipeline).agg(F.max_by("version", "at").alias("v")).first()
        return got["v"]

    def set(self, pipeline: str, version: int) -> None:
        row = self.spark.createDataFrame([(pipeline, version)], "pipeline string, version long").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self.path)
