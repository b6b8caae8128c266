"""Exact values at given places of an order (medians, quantiles, cut points of scores) without sorting, by refining value ranges.

A range of values is cut into BUCKETS steps and the rows in each step are counted, before the shuffle. The step that holds the
wanted place becomes the next range, from its least to its greatest value, until a range is one value. A round divides the
range by BUCKETS, and separates its least value from its greatest at the least, so it ends; three rounds are usual. Ranges of a
group are the same or apart, and places that are in one range share its counts, so a row is counted once a round, however many
places there are. No task holds a group's values: what is shuffled are counts, at most BUCKETS for each task and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.sources.scratch import materialize

BUCKETS = 4096
_PLACE, _FLOAT = "decimal(38,6)", (T.FloatType, T.DoubleType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)
_LARGEST = 8.9e307  # half the range of doubles: differences stay finite


def _number(df: DataFrame, c: str) -> str:
    """The type of _ordered: long for whole numbers, dates and timestamps, double for floating ones, decimal for the rest."""
    kind = df.schema[c].dataType
    return "long" if isinstance(kind, _WHOLE) else "double" if isinstance(kind, _FLOAT) else _PLACE


def _ordered(df: DataFrame, c: str) -> Column:
    """A number in the order of a column, exact but for floating types (infinities are the ends)."""
    kind = df.schema[c].dataType
    if isinstance(kind, _FLOAT):
        return F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c).cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST)))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if isinstance(kind, T.DecimalType) and kind.scale > 6:
        raise ValueError(f"{c} has over six decimal places")
    return F.col(c).cast(_number(df, c))


def _distance(x: str, low: str, number: str) -> Column:
    """x - low, which is not negative, as a double in the order of x. Of longs it may not fit into a long."""
    if number != "long":
        return (F.col(x) - F.col(low)).cast("double")
    far = F.greatest(F.col(x).cast("double") - F.col(low).cast("double"), F.lit(2.0**63))
    return F.coalesce(F.try_subtract(x, low).cast("double"), far)


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns], F.lit(True))


def order_statistics(df: DataFrame, groups: list[str], value: str, places: dict[str, str]) -> DataFrame:
    """(groups, place, n, value): for each group the value at each place, counted from 0 in ascending order.

    places: names and SQL expressions over n, the group's number of values; places outside 0 to n - 1 give no row. Nulls and NaN
    are no values, and a group without values has no row. Null groups are a group. value keeps its type. Doubles beyond 8.9e307
    in size count as equal.
    """
    number, kind_of_x, kind = _ordered(df, value), _number(df, value), df.schema[value].dataType
    there = F.col(value).isNotNull() & (~F.isnan(value) if isinstance(kind, _FLOAT) else F.lit(True))
    rows = materialize(df.where(there).select(*groups, number.alias("x"), F.col(value).alias("v")), "places")
    wanted = F.array(*[F.struct(F.lit(n).alias("place"), F.expr(e).cast("long").alias("at")) for n, e in places.items()])
    span = [F.min("x").alias("low"), F.max("x").alias("high"), F.min("v").alias("v")]
    found = rows.groupBy(*groups).agg(F.count("*").alias("n"), *span).select(*groups, "n", "low", "high", "v", F.inline(wanted)).where("at BETWEEN 0 AND n - 1")
    done, names = None, [*groups, "n", "place", "at", "low", "high", "v"]
    while True:
        found = materialize(found.select(*names), "ranges")
        ready, open_ = found.where("low = high"), found.where("low < high")
        done = ready if done is None else done.unionByName(ready)
        if open_.isEmpty():
            return done.select(*groups, "place", "n", F.col("v").alias(value))
        ranges = open_.select(*groups, "low", "high").distinct()
        inside = rows.alias("a").join(ranges.alias("b"), _same(rows, ranges, groups) & F.col("a.x").between(F.col("b.low"), F.col("b.high")))
        share = _distance("a.x", "b.low", kind_of_x) / _distance("b.high", "b.low", kind_of_x)
        step = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int")
        counts = inside.select(*[F.col(f"b.{c}").alias(c) for c in groups], F.col("b.low").alias("range_low"), F.col("b.high").alias("range_high"), step.alias("step"), "a.x", F.col("a.v").alias("v"))
        counts = counts.groupBy(*groups, "range_low", "range_high", "step").agg(F.count("*").alias("c"), *span)
        upto = F.sum("c").over(Window.partitionBy(*groups, "range_low", "range_high").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # BUCKETS rows at most
        counts = counts.withColumn("before", upto - F.col("c"))
        here = _same(open_, counts, groups) & (F.col("a.low") == F.col("b.range_low")) & (F.col("a.high") == F.col("b.range_high")) & F.col("a.at").between(F.col("b.before"), F.col("b.before") + F.col("b.c") - 1)
        placed = open_.alias("a").join(counts.alias("b"), here)
        found = placed.select(*[F.col(f"a.{c}").alias(c) for c in (*groups, "n", "place")], (F.col("a.at") - F.col("b.before")).alias("at"), "b.low", "b.high", "b.v")


def exact_median(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """(groups, name): the middle value of each group as a double, the mean of the two middle ones for an even number; null for
    groups without values."""
    two = order_statistics(df, groups, value, {"lower": "(n - 1) div 2", "upper": "n div 2"})
    middle = two.groupBy(*groups).agg((F.sum(F.col(value).cast("double") / 2)).alias(name))
    every = df.select(*groups).distinct()
    return every.alias("a").join(middle.alias("b"), _same(every, middle, groups), "left").select(*[F.col(f"a.{c}").alias(c) for c in groups], name)


def percent_rank_cuts(df: DataFrame, columns: list[str], k: int) -> dict[str, list]:
    """For each column k - 1 ordered numbers (or None), such that 1 plus how many of them a row exceeds is its score of 1 to k from
    percent_rank. Nulls rank lowest, NaN as infinity. df is read a few times; k - 1 numbers a column are collected.

    A row's score is over s if at least s * (rows - 1) / k rows have smaller values, rounded up; that is, if its value exceeds
    the one in that place, counted from 1. So the cuts are values at places, and no row has to be ranked.
    """
    first = df.agg(F.count(F.lit(1)), *[F.count(_ordered(df, c)) for c in columns]).first()
    total, filled = first[0], dict(zip(columns, first[1:], strict=True))
    cuts: dict[str, list] = {c: [] for c in columns}
    for number in ("long", "double", _PLACE):
        some = [c for c in columns if _number(df, c) == number]
        if not some or total < 2 or k < 2:
            continue
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), _ordered(df, c).alias("x")) for c in some])
        places = {str(s): f"{-(-s * (total - 1) // k) - 1} - ({total} - n)" for s in range(1, k)}  # less the nulls, which come first
        for r in order_statistics(df.select(F.inline(pairs)), ["name"], "x", places).collect():
            cuts[r["name"]].append(r["x"])
        for c in some:  # a place among the nulls: every value exceeds it
            nulls = total - filled[c]
            cuts[c] = [None] * sum(-(-s * (total - 1) // k) <= nulls for s in range(1, k)) + sorted(cuts[c])
    return cuts


def score_of(df: DataFrame, c: str, cuts: list) -> Column:
    """The score of a column by its cuts, from 1; null scores 1."""
    x, number = _ordered(df, c), _number(df, c)
    values = sorted(v for v in cuts if v is not None)
    cut = lambda v: F.lit(str(v)).cast(_PLACE) if number == _PLACE else F.lit(v).cast(number)

    def halved(low: int, high: int) -> Column:
        """The score of a value that exceeds the first `low` cuts at least and `high` at most."""
        if low == high:
            return F.lit(1 + len(cuts) - len(values) + low)
        middle = (low + high) // 2
        return F.when(x > cut(values[middle]), halved(middle + 1, high)).otherwise(halved(low, middle))

    return F.when(F.col(c).isNull(), F.lit(1)).otherwise(halved(0, len(values)))
