"""Joins: star, enriching, point in time, overlap, differences, skew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlib.functions import columns as C
from martlib.sources.scratch import in_ranges


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, str | list[str]]]) -> DataFrame:
    """Inner equi joins of a fact to its dimensions; small ones are broadcast by the optimizer, on their measured size."""
    return reduce(lambda df, d: df.join(d[0], d[1]), dims, fact)


def left_enrich(df: DataFrame, dim: DataFrame, on: str | list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    out = df.join(dim, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer expects of df's size, from files and statistics; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_join(big: DataFrame, small: DataFrame, on, how: str = "inner", most_bytes: int = 32 << 20) -> DataFrame:
    """Send the small side everywhere if it is expected to have most_bytes or fewer, else let both sides shuffle."""
    return big.join(F.broadcast(small) if estimated_bytes(small) <= most_bytes else small, on, how)


def merge_join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    return a.join(b.hint("merge"), on, how)


def point_in_time_join(fact: DataFrame, versions: DataFrame, key: str, at: str, how: str = "left", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The version that is valid on the fact's day; closed intervals. Null keys find none and stay with how='left'."""
    v = versions.withColumnRenamed(key, "__key")
    on = (fact[key] == v["__key"]) & F.to_date(fact[at]).between(v[start], v[end])
    return fact.join(v, on, how).drop("__key")


def as_of_join(fact: DataFrame, versions: DataFrame, key: str, at: str, how: str = "left", start: str = "valid_from", end: str | None = "valid_to") -> DataFrame:
    """As point_in_time_join, for versions that do not overlap, by a merge: facts and versions in one order of key and day, the last
    version carried forward. A fact costs the same however many versions its key has, and a key with most of the rows is spread
    over ranges; the last version of each range, one row, is carried into the next ones.

    end: the last day of a version, or None where a version lasts until the next one. Facts without a key or a day find none
    and stay with how='left'. Of versions that start on one day, one that ends later wins. The ranges are written when this is called.
    """
    if how not in ("inner", "left"):
        raise ValueError("versions without facts are not kept")
    taken = [c for c in versions.columns if c != key]
    if clash := {c.lower() for c in taken} & {c.lower() for c in fact.columns}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    pack = lambda df, columns: F.struct(*[F.col(f"`{c}`") for c in columns])
    v = versions.where(F.col(key).isNotNull() & F.col(start).isNotNull())
    v = v.select(F.col(key).alias("k"), F.col(start).cast("date").alias("t"), F.lit(0).alias("kind"), (F.col(end).cast("date") if end else F.lit(None).cast("date")).alias("until"), pack(v, taken).alias("v"))
    f = fact.select(F.col(key).alias("k"), F.to_date(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("until"), pack(fact, fact.columns).alias("f"))
    known, lost = f.where("k IS NOT NULL AND t IS NOT NULL"), f.where("k IS NULL OR t IS NULL").select("f.*")
    both = v.unionByName(known, allowMissingColumns=True).withColumn("tie", F.xxhash64("f"))
    ranged = in_ranges(both, ["k", "t", "kind", F.asc_nulls_last("until"), "tie"], "asof")
    version = F.when(F.col("kind") == 0, F.struct("k", "until", "v"))
    own = F.last(version, ignorenulls=True).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = ranged.groupBy("__part").agg(F.max_by(version, F.when(F.col("kind") == 0, F.col("__at"))).alias("e"))  # a row for each range
    carried = ends.select("__part", F.last("e", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("c"))
    found = ranged.withColumn("own", own).where("kind = 1").join(F.broadcast(carried), "__part").withColumn("last", F.coalesce("own", "c"))
    holds = (F.col("last.k") == F.col("k")) & (F.col("t") <= F.coalesce("last.until", "t"))
    out = found.select("f", F.when(holds, F.col("last.v")).alias("v"))
    if how == "inner":
        return out.where("v IS NOT NULL").select("f.*", "v.*")
    return out.select("f.*", "v.*").unionByName(lost, allowMissingColumns=True)


def version_on(versions: DataFrame, key: str, value, day: str) -> DataFrame:
    """The version of one key on one day."""
    return versions.where((F.col(key) == F.lit(value)) & F.lit(day).cast("date").between(F.col("valid_from"), F.col("valid_to")))


def resolve_member(fact: DataFrame, versions: DataFrame, key: str, at: str, group: str) -> DataFrame:
    """Identified rows by key and day, guests (null key) by group: two equi joins and a union. One join on either condition
    would leave no key to shuffle by. versions: guest members have a null key. Rows without a member are dropped."""
    known = point_in_time_join(fact.where(F.col(key).isNotNull()), versions.where(F.col(key).isNotNull()).drop(group), key, at, "inner")
    guests = fact.where(F.col(key).isNull()).join(versions.where(F.col(key).isNull()).drop(key), group)
    return known.unionByName(guests)


def anti_join(df: DataFrame, seen: DataFrame, on) -> DataFrame:
    return df.join(seen, on, "left_anti")


def semi_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def overlap_pairs(versions: DataFrame, key: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Versions that begin before an earlier one of their key has ended, with the latest such end. One sort for each key,
    no self join: a version overlaps an earlier one if and only if it starts by the greatest end before it."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return versions.withColumn("overlaps_until", F.max(end).over(before)).where(F.col(start) <= F.col("overlaps_until"))


def cross_with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(one_row))


def latest_only(df: DataFrame, ts: str) -> DataFrame:
    """Rows at the greatest timestamp of all."""
    return cross_with_scalar(df, df.agg(F.max(ts).alias("__last"))).where(F.col(ts) == F.col("__last")).drop("__last")


def salted_join(big: DataFrame, small: DataFrame, key: str, buckets: int, how: str = "inner", share: float = 0.01) -> DataFrame:
    """As the plain join on key, with each hot key of the big side spread over buckets. Rows without a key match nothing: with
    how='left' they stay where they are and are not shuffled.

    Hot keys have more than `share` of the big side's rows, so there are 1 / share of them at most; the small side is repeated for
    them alone. The salt is a hash of the row, so a task that runs again deals its rows as before. how: inner or left (the small
    side is repeated, so it can't be kept).
    """
    if how not in ("inner", "left"):
        raise ValueError("the repeated side's unmatched rows would be repeated too")
    if how == "left":
        alone, big = big.where(F.col(key).isNull()), big.where(F.col(key).isNotNull())
    counts, total = big.groupBy(key).agg(F.count("*").alias("__n")), big.agg(F.count("*").alias("__all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__n") > share * F.col("__all")).select(F.col(key), F.lit(buckets).alias("__buckets"))
    spread = F.coalesce(F.col("__buckets"), F.lit(1))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), spread).cast("int")
    salted = big.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__buckets")
    repeated = small.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop("__buckets")
    joined = salted.join(repeated, [key, "__salt"], how).drop("__salt")
    return joined.unionByName(alone, allowMissingColumns=True) if how == "left" else joined


def diff(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("only_a", "only_b")) -> DataFrame:
    """Rows on one side alone, repeats counted, labelled by side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit(names[0])).unionByName(b.exceptAll(a).withColumn("side", F.lit(names[1])))


def change_join(current: DataFrame, batch: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Rows of batch whose attributes differ from the current version of their key, null told from value."""
    old = current.select(key, *[F.col(c).alias(f"__{c}") for c in attributes])
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in attributes])
    return batch.join(old, key).where(differs).drop(*[f"__{c}" for c in attributes])


def union_by_name(frames: list[DataFrame], widen: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=widen), frames)


def labelled_slices(df: DataFrame, dimensions: dict[str, str | Column], keep: list[str], dimension: str = "dimension", value: str = "segment") -> DataFrame:
    """df once for each of several dimensions, labelled: one scan and an explode instead of as many unions."""
    pairs = F.array(*[F.struct(F.lit(n).alias(dimension), C.col(c).cast("string").alias(value)) for n, c in dimensions.items()])
    return df.select(F.explode(pairs).alias("__s"), *keep).select("__s.*", *keep)
