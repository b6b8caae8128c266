"""Checks. A check is an aggregate that counts offending rows; those on one table run in one pass.

Result rows: check_name, severity ('critical' or 'warn'), passed, observed (how many rows offend, or the value looked at).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.functions import columns as C
from martlib.operators.windows import daily_return


class ContractError(ValueError):
    """A table does not have the columns and types that were agreed."""


class ChecksFailed(ValueError):
    """A critical check failed."""


@dataclass(frozen=True)
class Check:
    """name, an aggregate over the table, and the test of its value (0 by default)."""

    name: str
    observed: Column
    passed: str = "observed = 0"
    severity: str = "critical"


def offending(bad: Column) -> Column:
    return F.count(F.when(bad, F.lit(1)))


def not_null(c: str) -> Check:
    return Check(f"{c} is not null", offending(F.col(c).isNull()))


def unique(c: str) -> Check:
    return Check(f"{c} is unique", F.count(c) - F.count_distinct(c))


def accepted_values(c: str, values: list) -> Check:
    return Check(f"{c} has accepted values", offending(~F.col(c).isin(*values)))


def in_range(c: str, low=None, high=None) -> Check:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(c) < F.lit(low))
    if high is not None:
        bad = bad | (F.col(c) > F.lit(high))
    return Check(f"{c} in range", offending(bad))


def holds(name: str, expression: Column, allow_null: bool = False, severity: str = "critical") -> Check:
    return Check(name, offending(~F.coalesce(expression, F.lit(allow_null))), severity=severity)


def at_least(name: str, observed: Column, least) -> Check:
    return Check(name, observed, f"observed >= {least}")


def fresh(ts: str, now: str, warn_hours: float, error_hours: float) -> list[Check]:
    """Age of the newest row at `now`, in hours; no row at all fails."""
    age = F.coalesce((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.max(F.col(ts).cast("timestamp")))) / 3600, F.lit(1e9))
    return [Check(f"{ts} within {warn_hours} h", age, f"observed <= {warn_hours}", "warn"), Check(f"{ts} within {error_hours} h", age, f"observed <= {error_hours}")]


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All checks in one aggregate over df, as rows."""
    row = df.agg(*[c.observed.cast("double").alias(f"c{i}") for i, c in enumerate(checks)])
    one = lambda i, c: F.struct(F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"), F.col(f"c{i}").alias("observed"), F.expr(c.passed.replace("observed", f"c{i}")).alias("passed"))
    rows = row.select(F.explode(F.array(*[one(i, c) for i, c in enumerate(checks)])).alias("r")).select("r.*")
    return rows.select("check_name", "severity", F.coalesce("passed", F.lit(False)).alias("passed"), "observed")


def as_check(name: str, df: DataFrame, severity: str = "critical") -> DataFrame:
    """A check of a whole DataFrame of offending rows: none may be there."""
    return run_checks(df, [Check(name, F.count(F.lit(1)), severity=severity)])


def unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    """The combinations that occur more than once, with their number."""
    return df.groupBy(*columns).count().where("count > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key the parent lacks; a null key refers to nothing and is no orphan."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def sums_match(a: DataFrame, ca: str, b: DataFrame, cb: str, name: str, tolerance: float = 0.0) -> DataFrame:
    """The difference of two layers' sums."""
    left, right = a.agg(F.sum(ca).alias("x")), b.agg(F.sum(cb).alias("y"))
    gap = F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).cast("double")
    return left.crossJoin(F.broadcast(right)).select(F.lit(name).alias("check_name"), F.lit("critical").alias("severity"), (gap <= tolerance).alias("passed"), gap.alias("observed"))


def sum_equals_rows(summary: DataFrame, c: str, source: DataFrame, name: str) -> DataFrame:
    return sums_match(summary, c, source.select(F.lit(1).alias("one")), "one", name)


def load_reconciles(raw: DataFrame, facts: DataFrame, rejected: DataFrame, revenue: str = "revenue", raw_revenue: str = "revenue") -> DataFrame:
    """Each raw line is a fact or rejected; revenue is the same; the load is not empty."""
    def totals(df, c, count, money):  # one pass over each side
        return df.agg(F.count(F.lit(1)).alias(count), F.coalesce(F.sum(C.money(c)), F.lit(0)).cast("decimal(38,2)").alias(money))

    sides = [totals(raw, raw_revenue, "raw", "rm"), totals(facts, revenue, "facts", "fm"), totals(rejected, raw_revenue, "rejected", "jm")]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), sides)
    rows = F.array(
        F.struct(F.lit("every line is loaded or rejected").alias("check_name"), (F.col("raw") == F.col("facts") + F.col("rejected")).alias("passed"), (F.col("raw") - F.col("facts") - F.col("rejected")).cast("double").alias("observed")),
        F.struct(F.lit("revenue reconciles").alias("check_name"), (F.col("rm") == F.col("fm") + F.col("jm")).alias("passed"), (F.col("rm") - F.col("fm") - F.col("jm")).cast("double").alias("observed")),
        F.struct(F.lit("the load is not empty").alias("check_name"), (F.col("raw") > 0).alias("passed"), F.col("raw").cast("double").alias("observed")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.check_name", F.lit("critical").alias("severity"), "r.passed", "r.observed")


def one_current_version(dim: DataFrame, key: str) -> DataFrame:
    """Keys with any number of current versions but one."""
    return dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.col("is_current").cast("int")).alias("current")).where("current <> 1")


def enforce_contract(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """df, if its column names and types are exactly those of the contract, in order; else an error that says what differs."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    need = [(f.name, f.dataType.simpleString()) for f in want]
    if have != need:
        raise ContractError(f"expected {need}, found {have}")
    return df


def require(results: DataFrame) -> DataFrame:
    """results, unless a critical check failed; warnings pass."""
    if failed := [r["check_name"] for r in results.where("NOT passed AND severity = 'critical'").collect()]:
        raise ChecksFailed(", ".join(failed))
    return results


def weather_checks() -> list[Check]:
    """Missing measures are allowed; what is there has to make sense."""
    ok = lambda name, e: holds(name, e, allow_null=True)
    return [
        ok("least is not above greatest", F.col("temp_min") <= F.col("temp_max")),
        ok("temperatures within 60 degrees", (F.abs("temp_min") <= 60) & (F.abs("temp_max") <= 60)),
        ok("nothing negative", (F.col("precipitation") >= 0) & (F.col("wind_speed") >= 0)),
        Check("one row for a city and day", F.count(F.lit(1)) - F.count_distinct("city", "date")),
    ]


def price_checks() -> list[Check]:
    return [
        holds("positive prices", F.least("open", "high", "low", "close") > 0),
        holds("open and close within the day's range", (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))),
        holds("volume is not negative", F.col("volume") >= 0),
    ]


def price_table_checks(prices: DataFrame, today: str, most: float = 0.5) -> DataFrame:
    moves = daily_return(prices, ["symbol"], "trade_date", "close", "__move")
    return run_checks(moves, [
        Check("no future trading day", offending(F.col("trade_date") > F.lit(today).cast("date"))),
        Check("no weekend trading day", offending(C.is_weekend("trade_date"))),
        Check("daily move within bounds", offending(F.abs("__move") > most)),
    ])


def feed_completeness(status: DataFrame, info: DataFrame, key: str, least: int, most_unknown: float = 0.05) -> DataFrame:
    """Rows of a snapshot, and the share that refers to nothing known."""
    known = status.join(info.select(key).distinct().withColumn("__known", F.lit(True)), key, "left")
    unknown = F.coalesce(offending(F.col("__known").isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0))
    return run_checks(known, [at_least("enough rows", F.count(F.lit(1)), least), Check("few unknown references", unknown, f"observed <= {most_unknown}")])


def monitoring_checks(snapshots: DataFrame, ts: str, now: str, least: int = 1000) -> DataFrame:
    """The smallest snapshot of 24 hours, and whether the last hour's values move."""
    end = F.lit(now).cast("timestamp")
    recent = snapshots.where(F.col(ts).cast("timestamp") > end - F.expr("INTERVAL 24 HOURS"))
    sizes = recent.groupBy(ts).agg(F.count("*").alias("n"), F.sum("bikes").alias("bikes"))
    last_hour = F.when(F.col(ts).cast("timestamp") > end - F.expr("INTERVAL 1 HOUR"), F.col("bikes"))
    return run_checks(sizes, [at_least("smallest snapshot of a day", F.min("n"), least), Check("not frozen", F.count_distinct(last_hour), "observed > 1")])


def over_capacity(status: DataFrame, stations: DataFrame, key: str, tolerance: int = 2) -> DataFrame:
    """Stations that report more places than they have; a warning only."""
    return as_check("within capacity", status.join(stations.select(key, "capacity"), key).where(F.col("bikes") + F.col("docks") > F.col("capacity") + tolerance), "warn")


def campaign_rules() -> list[tuple[str, Column]]:
    """Offences of contact rows, for aggregates.rule_counts."""
    return [
        ("month name not recognized", F.col("month_num").isNull()),
        ("age outside 17-100", ~F.col("age").between(17, 100)),
        ("campaign contacts < 1", F.col("campaign") < 1),
        ("outcome not yes/no", ~F.col("y").isin("yes", "no")),
        ("contact month outside May 2008 - Nov 2010", ~F.col("contact_month").between(F.lit("2008-05-01").cast("date"), F.lit("2010-11-01").cast("date"))),
    ]
