"""Merges, history and incremental loads. All are idempotent: applied again with the same input, they change nothing. Null
keys are keys: null equals null.

Targets are DataFrames, and each function returns the new target; sources.writers publishes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.functions import columns as C
from martlib.operators.windows import close_intervals, islands_by_change, latest_per_key
from martlib.sources.scratch import in_ranges, range_starts


def _differs(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(False))


def _matched(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join by keys, null equal to null."""
    b = other.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return df.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how)


def scd2_merge(dim: DataFrame, snapshot: DataFrame, key: str, attributes: list[str], as_of: Column | str) -> DataFrame:
    """dim (key, attributes, valid_from, valid_to, is_current) after a snapshot (key, attributes) of the day as_of.

    Changed after valid_from: the version ends the day before, and a new one begins. Changed on valid_from itself: corrected
    in place. New key: inserted. Unchanged, or older than the current version: nothing. Closed versions do not take part in
    the join. snapshot has one row for each key.
    """
    day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    new = snapshot.select(F.col(key).alias("__key"), F.struct(*attributes).alias("s"), day.alias("__day"))
    old = dim.where("is_current").select(key, F.struct(*attributes).alias("o"), "valid_from")
    pairs = old.join(new, F.col(key).eqNullSafe(F.col("__key")), "full")
    values = lambda side: [F.col(f"{side}.{c}").alias(c) for c in attributes]
    end = F.lit(C.OPEN_END).cast("date")
    row = lambda side, start, stop, current: F.struct(F.coalesce(F.col(key), F.col("__key")).alias(key), *values(side), start.alias("valid_from"), stop.alias("valid_to"), F.lit(current).alias("is_current"))
    kept, opened = row("o", F.col("valid_from"), end, True), row("s", F.col("__day"), end, True)
    closed, corrected = row("o", F.col("valid_from"), F.date_sub("__day", 1), False), row("s", F.col("valid_from"), end, True)
    changed = F.col("s").isNotNull() & _differs("o", "s", attributes)
    out = (
        F.when(F.col("o").isNull(), F.array(opened))
        .when(changed & (F.col("__day") > F.col("valid_from")), F.array(closed, opened))
        .when(changed & (F.col("__day") == F.col("valid_from")), F.array(corrected))
        .otherwise(F.array(kept))
    )
    names = [key, *attributes, "valid_from", "valid_to", "is_current"]
    return dim.where("NOT is_current").select(*names).unionByName(pairs.select(F.explode(out).alias("v")).select("v.*"))


def scd2_rebuild(events: DataFrame, key: str, attribute: str, at: str, tie: list[Column | str]) -> DataFrame:
    """The whole history from all events: the day's last value of each key, runs of equal values, closed intervals. Rows
    without a key are left out. Dealing the needed columns out by key serves all windows and the aggregate: one shuffle."""
    needed = list(dict.fromkeys([key, attribute, at, *tie])) if all(isinstance(t, str) for t in tie) else events.columns
    day = events.where(F.col(key).isNotNull()).select(*needed).withColumn("__day", F.to_date(at)).repartition(F.col(key))
    days = latest_per_key(day, [key, "__day"], [F.desc(at), *[C.col(t) if isinstance(t, Column) else F.desc(t) for t in tie]])
    return versions_of_days(days, key, attribute, "__day").withColumn("version_key", C.surrogate_key(key, "version_number"))


def versions_of_days(days: DataFrame, key: str, attribute: str, day: str) -> DataFrame:
    """(key, version_number, attribute, valid_from, valid_to, is_current) from one row for each key and day."""
    runs = islands_by_change(days.select(key, day, attribute), [key], [day], attribute)
    versions = runs.groupBy(key, "version_number").agg(F.first(attribute).alias(attribute), F.min(day).alias("valid_from"))
    return close_intervals(versions, [key])


def last_of_day(events: DataFrame, key: str, attribute: str, at: str, tie: str, day: str = "day", sums: dict[str, Column] | None = None, groups: bool = False) -> DataFrame:
    """(key, day, attribute): the last value of each key on each day, with further aggregates `sums`. Rows without a key are left
    out; with groups they are a row for each of their attributes and days."""
    last, more = F.max_by(attribute, F.struct(at, tie)).alias(attribute), [c.alias(n) for n, c in (sums or {}).items()]
    group = F.when(F.col(key).isNull(), F.col(attribute)).alias("__group")
    return events.where(F.lit(groups) | F.col(key).isNotNull()).groupBy(key, F.to_date(at).alias(day), group).agg(last, *more).drop("__group")


def splice_versions(dim: DataFrame, seen: DataFrame, replaced: DataFrame, fresh: DataFrame, key: str, attribute: str, day: str = "day") -> DataFrame:
    """dim (key, attribute, valid_from, valid_to, is_current) after any set of days, late ones too, in one pass.

    seen: what was known of each key on the days that stay (key, day, attribute); replaced: rows of the same form that the load
    takes back; fresh: those that it brings. Only keys in replaced or fresh are touched: their change points are spliced into
    what was seen of them, so an interval in the middle opens, closes, splits or merges with its neighbours. All other versions
    pass unread. The result is what scd2_rebuild gives for all days together.
    """
    touched = replaced.select(key).union(fresh.select(key)).distinct()
    known = _matched(seen, touched, [key], "left_semi").select(key, day, attribute).unionByName(fresh.select(key, day, attribute))
    columns = [key, attribute, "valid_from", "valid_to", "is_current"]
    return _matched(dim, touched, [key], "left_anti").select(*columns).unionByName(versions_of_days(known, key, attribute, day).select(*columns))


def scd2_replay(events: DataFrame, key: str, attribute: str, at: str, tie: list, days: list[str], empty: DataFrame) -> DataFrame:
    """scd2_merge for one day after another (backfill)."""
    dim = empty
    for d in days:
        of_day = events.where((F.to_date(at) == F.lit(d).cast("date")) & F.col(key).isNotNull())
        last = latest_per_key(of_day, [key], [F.desc(at), *[F.desc(t) for t in tie]]).select(key, attribute)
        dim = scd2_merge(dim, last, key, [attribute], d)
    return dim


def scd1_upsert(dim: DataFrame, batch: DataFrame, key: str, description: str, order: list[Column]) -> DataFrame:
    """Latest non-empty description of each key; an empty one never replaces another."""
    best = latest_per_key(batch, [key], [F.col(description).isNull().asc(), *order]).select(F.col(key).alias("__key"), F.col(description).alias("__new"))
    both = dim.select(key, description).join(best, F.col(key).eqNullSafe(F.col("__key")), "full")
    return both.select(F.coalesce(key, "__key").alias(key), F.coalesce("__new", description).alias(description))


def scd1_latest(dim: DataFrame, batch: DataFrame, key: str, description: str, at: str, tie: str) -> DataFrame:
    """As scd1_upsert, but the dimension remembers when it learned a description, so an old batch that runs again cannot
    replace a later one. Columns: key, description, at, tie."""
    columns = [key, description, at, tie]
    both = dim.select(*columns).unionByName(batch.select(*columns))
    return latest_per_key(both, [key], [F.col(description).isNull().asc(), F.desc_nulls_last(at), F.desc_nulls_last(tie)])


def scd1_rebuild(lines: DataFrame, key: str, description: str, at: str, tie: str) -> DataFrame:
    """The same from all lines, with the first and last day of each key; one shuffle by key."""
    order = F.struct(F.col(description).isNotNull().alias("a"), F.col(at).alias("b"), F.col(tie).alias("c"))
    best = lines.groupBy(key).agg(F.max_by(description, order).alias(description), F.min(F.to_date(at)).alias("first_sold_on"), F.max(F.to_date(at)).alias("last_sold_on"))
    return best.withColumn(description, F.coalesce(F.col(description), F.col(key).cast("string")))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's row wins on its key. batch has one row for each key."""
    return _matched(target, batch, keys, "left_anti").unionByName(batch.select(*target.columns))


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key the target lacks, one for each key: append them to insert only what is new."""
    return _matched(batch.dropDuplicates(keys), target, keys, "left_anti")


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(new_rows(target, batch, keys), allowMissingColumns=True)


def merge_with_changes(target: DataFrame, batch: DataFrame, keys: list[str], gone: Column | None = None) -> DataFrame:
    """What a merge of batch into target changes, from one full join: rows of target's columns with change: 'insert', 'update_before'
    and 'update_after', 'delete'. Rows that stay as they are give none.

    batch has one row for each key. gone: a test of batch rows that delete their key; of a key that target lacks nothing comes.
    """
    names, same = target.columns, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    old, new = F.struct(*[F.col(f"a.{c}").alias(c) for c in names]), F.struct(*[F.col(f"b.{c}").alias(c) for c in names])
    both = target.withColumn("__a", F.lit(True)).alias("a").join(batch.withColumns({"__b": F.lit(True), "__gone": F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))}).alias("b"), same, "full")
    row = lambda kind, values: F.struct(F.lit(kind).alias("change"), values.alias("row"))
    there, comes, dies = F.col("a.__a").isNotNull(), F.col("b.__b").isNotNull(), F.coalesce(F.col("b.__gone"), F.lit(False))
    made = (
        F.when(there & dies, F.array(row("delete", old)))
        .when(there & comes & ~old.eqNullSafe(new), F.array(row("update_before", old), row("update_after", new)))
        .when(~there & ~dies, F.array(row("insert", new)))
    )
    return both.select(F.explode(made).alias("c")).select("c.row.*", "c.change")


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target after changes of one merge: applied again, they change nothing more."""
    now = changes.where("change IN ('insert', 'update_after')").select(*target.columns)
    return _matched(target, changes.select(*keys).distinct(), keys, "left_anti").unionByName(now)


def net_changes(log: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """One merge's worth of changes from those of several versions: of each key what it was before the first and is after the last.
    A key that came and went, or ends as it began, has none."""
    first = F.min_by(F.struct("*"), F.struct(version, F.when(F.col("change") == "update_after", 1).otherwise(0)))
    last = F.max_by(F.struct("*"), F.struct(version, F.when(F.col("change") == "update_after", 1).otherwise(0)))
    ends = log.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(first.alias("a"), last.alias("b"))
    names = [c for c in log.columns if c not in (version, "change")]
    old, new = (F.struct(*[F.col(f"{x}.{c}").alias(c) for c in names]) for x in ("a", "b"))
    was, stays = F.col("a.change") != "insert", F.col("b.change") != "delete"
    row = lambda kind, values: F.struct(F.lit(kind).alias("change"), values.alias("row"))
    made = (
        F.when(was & stays & ~old.eqNullSafe(new), F.array(row("update_before", old), row("update_after", new)))
        .when(was & ~stays, F.array(row("delete", old)))
        .when(~was & stays, F.array(row("insert", new)))
    )
    return ends.select(F.explode(made).alias("c")).select("c.row.*", "c.change")


def upsert_if_newer(target: DataFrame, batch: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The later row of each key; a late load can't overwrite, and on equal times the batch wins."""
    both = target.withColumn("__b", F.lit(0)).unionByName(batch.withColumn("__b", F.lit(1)))
    return latest_per_key(both, keys, [F.desc_nulls_last(ts), F.desc("__b")]).drop("__b")


def replace_batch(target: DataFrame, batch: DataFrame, batch_column: str) -> DataFrame:
    """All rows of the batch's dates are replaced by the batch."""
    return _matched(target, batch.select(batch_column).distinct(), [batch_column], "left_anti").unionByName(batch.select(*target.columns))


def incremental(target: DataFrame, source: DataFrame, keys: list[str], by: str, lookback: str) -> DataFrame:
    """Source rows from lookback (an interval) before the target's greatest `by` on replace the target's rows of their keys.
    An empty target takes all."""
    start = target.agg((F.max(by) - F.expr(f"INTERVAL {lookback}")).alias("__from"))
    fresh = source.crossJoin(F.broadcast(start)).where(F.col("__from").isNull() | (F.col(by) >= F.col("__from"))).drop("__from")
    return upsert(target, fresh, keys)


def recompute_changed(target: DataFrame, source: DataFrame, changed: DataFrame, key: str, fn) -> DataFrame:
    """fn over the source rows of the changed keys, in place of the target's rows of those keys."""
    keys = changed.select(key).distinct()
    fresh = fn(_matched(source, keys, [key], "left_semi"))
    return _matched(target, keys, [key], "left_anti").unionByName(fresh.select(*target.columns))


def count_delta(inserted: DataFrame, batch_id, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of one batch's new rows, with the batch's id: a replay writes the same rows again."""
    return inserted.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]).withColumn("batch_id", F.lit(batch_id))


def add_counts(deltas: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Totals over all batches, each batch once, whatever its replays."""
    once = deltas.dropDuplicates([*keys, "batch_id"])
    return once.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def missing_members(dim: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Distinct values that the dimension lacks; null equals null."""
    new = values.select(*on).distinct()
    same = reduce(lambda x, y: x & y, [new[c].eqNullSafe(dim[c]) for c in on])
    return new.join(dim, same, "left_anti")


def guest_members(dim: DataFrame, lines: DataFrame, key: str, group: str) -> DataFrame:
    """A member without a key for each group that has guests; open from the beginning, and never versioned."""
    groups = lines.where(F.col(key).isNull()).select(group).distinct()
    new = _matched(groups, dim.where(F.col(key).isNull()), [group], "left_anti")
    kind = dim.schema[key].dataType
    return new.select(F.lit(None).cast(kind).alias(key), group, F.lit("0001-01-01").cast("date").alias("valid_from"), F.lit(C.OPEN_END).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))


def assign_surrogate_keys(dim: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Integers after the dimension's greatest, in the given order, numbered by ranges, which are written when this is called.
    An order with ties falls anyhow among them."""
    most = dim.agg(F.coalesce(F.max(key), F.lit(0)).alias("__most"))
    ranged = in_ranges(new, list(order), "keys")
    placed = ranged.join(F.broadcast(range_starts(ranged, F.count("*"))), "__part").crossJoin(F.broadcast(most))
    number = (F.col("__most") + F.col("__start") + F.col("__at") + 1).cast("long")
    return placed.withColumn(key, number).select(*[c for c in new.columns if c != key], key)


def evolve_schema(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Union by name; old rows get null in new columns, and new ones in old columns."""
    return target.unionByName(batch, allowMissingColumns=True)


def dim_date(spark: SparkSession, first: str, last: str) -> DataFrame:
    return _calendar(spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day"))


def dim_date_of(df: DataFrame, ts: str) -> DataFrame:
    """The calendar from a column's first day to its last; nothing runs until it is read."""
    span = df.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b"))
    return _calendar(span.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day")))


def _calendar(days: DataFrame) -> DataFrame:
    return days.select(
        C.date_key("day").alias("date_key"), "day", F.year("day").alias("year"), F.quarter("day").alias("quarter"), F.month("day").alias("month"),
        F.date_format("day", "MMMM").alias("month_name"), F.dayofmonth("day").alias("day_of_month"), C.iso_weekday("day").alias("iso_weekday"),
        F.date_format("day", "EEEE").alias("day_name"), C.is_weekend("day").alias("is_weekend"),
    )
