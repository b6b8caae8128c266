"""Tables laid out by several columns at once, so that a reader opens the files that can hold its rows and no others."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.operators.quantiles import percent_rank_cuts, score_of
from martlib.sources.writers import Publisher

#: Bits of each column in the order of rows.
BITS = 5


def interleaved(df: DataFrame, columns: list[str], bits: int = BITS) -> Column:
    """A number whose bits are, in turn, those of each column's rank among 2**bits classes of equal size (nulls lowest), so that
    rows near each other in it are near in every column. columns: numbers, dates or timestamps. df is read a few times to find
    the classes' bounds, by counting; no row is ranked or moved."""
    cuts = percent_rank_cuts(df, columns, 1 << bits)
    ranks = {c: score_of(df, c, cuts[c]) - 1 for c in columns}
    key = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for c in columns:
            key = 2 * key + F.shiftright(ranks[c], bit).bitwiseAND(F.lit(1))
    return key


def even_cuts(cells: list[tuple[int, int]], files: int) -> list[int] | None:
    """The last cell of each file but the last one, for files of about as many rows. cells: (number, rows) in order. A cut lies within a
    quarter of a file of its even place, before the roundest number there: cells that share their leading bits lie near each other,
    and a file that ends among them reaches into two such groups. None if one place has no end of a cell so near."""
    share, ends, upto = sum(rows for _, rows in cells) / files, [], 0
    for (cell, rows), (after, _) in zip(cells, cells[1:]):
        upto += rows
        # the highest bit in which a cell differs from the next one: the higher, the rounder the place between them
        ends.append((upto, (cell ^ after).bit_length(), cell))
    cuts = []
    for n in range(1, files):
        near = [(-roundness, abs(upto - n * share), cell) for upto, roundness, cell in ends if abs(upto - n * share) < share / 4]
        if not near:
            return None
        cuts.append(min(near)[2])
    return cuts


class ClusteredTable:
    """A table in files of rows near each other in several columns, with a table of each file's least and greatest values.

    A rewrite is a run of its own: data and list of files are complete before the pointer moves, and readers keep the last
    published one until then. A rewrite that stops changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, columns: list[str]):
        self.spark, self.columns, self.tables = spark, columns, Publisher(spark, root)

    def write(self, df: DataFrame, files: int) -> None:
        """Replace the table by df, in about so many files. df may read the table."""
        run = uuid.uuid4().hex
        keyed = df.withColumn("__key", interleaved(df, self.columns))
        data = self.tables.write(run, "data", self._dealt(keyed, files).sortWithinPartitions("__key", *self.columns).drop("__key"))
        spans = [f(c).alias(f"{n}_{c}") for c in self.columns for n, f in (("low", F.min), ("high", F.max))] + [F.count(F.lit(1)).alias("rows")]
        nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in self.columns]
        self.tables.write(run, "files", data.select("*", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(*spans, *nulls).coalesce(1))
        self.tables.publish(run)

    def _dealt(self, keyed: DataFrame, files: int) -> DataFrame:
        """Rows of a file together: cut where the leading bits of the key change, or in ranges of any values if some are too many."""
        unused = max(0, BITS * len(self.columns) - files.bit_length() - 5)  # 32 to 64 cells a file
        keyed = keyed.withColumn("__cell", F.shiftright("__key", unused))
        cuts = even_cuts(sorted(tuple(r) for r in keyed.groupBy("__cell").count().collect()), files)
        if cuts is None:
            return keyed.drop("__cell").repartitionByRange(files, "__key", *self.columns)
        return keyed.repartitionById(files, score_of(keyed, "__cell", cuts) - 1).drop("__cell")

    def compact(self, files: int) -> None:
        """The same rows, clustered anew."""
        self.write(self.all(), files)

    def append(self, df: DataFrame, files: int) -> None:
        """More rows; the whole table is clustered anew, as files of old and new rows overlap otherwise."""
        now = self.tables.read("data")
        self.write(df if now is None else now.unionByName(df), files)

    def all(self) -> DataFrame:
        return self.tables.read("data")

    def picked(self, ranges: dict[str, tuple]) -> tuple[list[str], int]:
        """(files that can hold rows within all ranges, number of all files). ranges: least and greatest value by column, ends
        included, None for no bound; what is null lies in no range."""
        files, fits = self.tables.read("files"), F.lit(True)
        for c, (low, high) in ranges.items():
            fits = fits & F.col(f"low_{c}").isNotNull()
            fits = fits if low is None else fits & (F.col(f"high_{c}") >= F.lit(low))
            fits = fits if high is None else fits & (F.col(f"low_{c}") <= F.lit(high))
        return [r["file"] for r in files.where(fits).select("file").collect()], files.count()  # a row for each file

    def read(self, ranges: dict[str, tuple]) -> DataFrame:
        """Rows within all ranges, from the files that can hold them."""
        files, _ = self.picked(ranges)
        found = self.spark.read.schema(self.all().schema).parquet(*files) if files else self.all().limit(0)
        for c, (low, high) in ranges.items():
            found = found.where(F.col(c).isNotNull())
            found = found if low is None else found.where(F.col(c) >= F.lit(low))
            found = found if high is None else found.where(F.col(c) <= F.lit(high))
        return found
