"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlib.functions import columns as C
from martlib.operators.windows import numbered


def group_agg(df: DataFrame, keys: list, aggs: dict[str, Column], having: Column | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out if having is None else out.where(having)


def where(agg, c: Column | str, test: Column) -> Column:
    """agg over the rows that pass a test of their own, for example where(F.sum, 'x', F.col('y') > 0)."""
    return agg(F.when(test, C.col(c)))


def count_where(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def rollup_within(df: DataFrame, rolled: list[str], fixed: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Subtotals over the rolled columns from the right, always by the fixed ones: one grouping set for each level."""
    sets = [[*rolled[:k], *fixed] for k in range(len(rolled), -1, -1)]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *rolled, *fixed).agg(*[a.alias(n) for n, a in aggs.items()])


def share_of_total(counts: DataFrame, c: str, name: str = "share_pct", digits: int = 2) -> DataFrame:
    """Per cent of the total of all rows; counts has a row for each group."""
    total = counts.agg(F.sum(c).alias("__all"))
    return counts.crossJoin(F.broadcast(total)).withColumn(name, C.percent_of(F.col(c), F.col("__all"), digits)).drop("__all")


def per_day_average(day: Column) -> Column:
    """Rows for each distinct day of a group."""
    return F.count("*") / F.count_distinct(day)


def any_true(c: Column | str) -> Column:
    return F.bool_or(C.col(c))


def all_true(c: Column | str) -> Column:
    return F.bool_and(C.col(c))


def first_by(c: str, order: str) -> Column:
    return F.min_by(c, order)


def last_by(c: str, order: str) -> Column:
    return F.max_by(c, order)


def annual_volatility(daily: Column | str, days: int = 252) -> Column:
    return 100 * F.stddev_samp(C.col(daily)) * F.sqrt(F.lit(days))


def rule_counts(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(rule, violations) of all rules in one pass; a rule that comes out null is violated."""
    row = df.agg(*[F.count(F.when(F.coalesce(r, F.lit(True)), 1)).alias(f"r{i}") for i, (_, r) in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (n, _) in enumerate(rules)])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def quality_report(df: DataFrame, verdict: str = "quality") -> DataFrame:
    """Rows and share of each verdict."""
    return share_of_total(df.groupBy(verdict).agg(F.count("*").alias("rows")), "rows")


def two_level(df: DataFrame, inner: list[str], outer: list[str], flags: dict[str, Column], name: str) -> DataFrame:
    """Flags for each inner group (say a session), then their share for each outer group, and the number of inner groups."""
    per = df.groupBy(*dict.fromkeys([*outer, *inner])).agg(*[F.max(f.cast("int")).alias(n) for n, f in flags.items()])
    return per.groupBy(*outer).agg(F.count("*").alias(name), *[F.round(100 * F.avg(n), 2).alias(n) for n in flags])


def unpivot(df: DataFrame, ids: list[str], values: list[str], names: tuple[str, str] = ("metric", "value")) -> DataFrame:
    return df.unpivot(ids, values, *names)


def prefix_sum(df: DataFrame, part: list[str], order: str, c: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(c).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def distinct_bitmaps(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """(keys, bucket, bits): the distinct values of c by keys as bitmaps that can be merged. Values are numbered densely once, and a
    bucket holds 32,768 numbers in 4 KB; nulls are no values. The numbers are written when this is called."""
    ids = number_values(df, c).withColumnRenamed(c, "__value")
    placed = df.where(F.col(c).isNotNull()).select(*keys, c).distinct().join(ids, F.col(c) == F.col("__value"))
    bit = F.bitmap_construct_agg(F.bitmap_bit_position("number"))
    return placed.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(bit.alias("bits"))


def number_values(df: DataFrame, c: str) -> DataFrame:
    """(c, number): the distinct values of c in order, 1, 2, 3 ..., by ranges."""
    return numbered(df.select(c).where(F.col(c).isNotNull()).distinct(), c, "number")


def merge_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of coarser keys from those of finer ones."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many distinct values there are by keys, exactly. Keys whose values are all null have no row."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
