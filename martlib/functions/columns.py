"""Reusable expressions. Each takes Columns (or names) and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The countries that count as Europe, in alphabetical order.
EUROPE = (
    "Austria", "Belgium", "Channel Islands", "Cyprus", "Czech Republic", "Denmark", "EIRE", "European Community",
    "Finland", "France", "Germany", "Greece", "Iceland", "Italy", "Lithuania", "Malta", "Netherlands", "Norway",
    "Poland", "Portugal", "Spain", "Sweden", "Switzerland",
)
#: Names of months as the contact files write them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
OPEN_END = "9999-12-31"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str, scale: int = 2) -> Column:
    """Exact decimal, rounded half up. The cast comes first: binary rounding would differ in the last place."""
    return F.round(col(c).cast("decimal(18,6)"), scale).cast(f"decimal(18,{scale})")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def percent_of(a: Column, b: Column, digits: int = 1) -> Column:
    """100 * a / b rounded, null where b is 0. The product comes first: it is exact for counts, where 100 * (a / b) can end below a
    half (23 of 80: 28.749999999999996)."""
    return F.round(ratio(100.0 * a, b), digits)


def pct(flag: Column | str, digits: int = 1) -> Column:
    """Aggregate: 100 times the mean of a boolean, nulls left out."""
    return F.round(100 * F.avg(col(flag).cast("int")), digits)


def line_type(invoice: Column | str, quantity: Column | str) -> Column:
    cancelled, negative = F.startswith(col(invoice), F.lit("C")), col(quantity) < 0
    return F.when(cancelled, "cancellation").when(negative, "stock_adjustment").otherwise("sale")


def is_rejected(quantity: Column | str, price: Column | str) -> Column:
    """No quantity or a negative price. A missing value is a reason to reject, too."""
    return F.coalesce((col(quantity) == 0) | (col(price) < 0), F.lit(True))


def is_product(code: Column | str) -> Column:
    return col(code).rlike("^[0-9]{5}")


def region_of(country: Column | str) -> Column:
    c = col(country)
    return F.when(c == "United Kingdom", c).when(c.isin(*EUROPE), "Europe").otherwise("Rest of world")


REGION_SQL = f"CASE WHEN country = 'United Kingdom' THEN country WHEN country IN ({', '.join(repr(c) for c in EUROPE)}) THEN 'Europe' ELSE 'Rest of world' END"


def register_functions(spark) -> None:
    """The scalar functions for SQL users, as SQL functions that the optimizer inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION region_of(country STRING) RETURNS STRING RETURN {REGION_SQL}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION date_key(d DATE) RETURNS INT RETURN CAST(date_format(d, 'yyyyMMdd') AS INT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION money(x DOUBLE) RETURNS DECIMAL(18,2) RETURN CAST(round(CAST(x AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))")


def lookup_map(code: Column | str, labels: dict, default: str | None = None) -> Column:
    """A code's label; a code that is not listed, or null, gets the default."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col(code)), F.lit(default))


def band(c: Column | str, edges: list, labels: list[str]) -> Column:
    """labels[k] for values under edges[k] (and not under the one before), the last label from the last edge up."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges")
    out = None
    for edge, label in zip(edges, labels, strict=False):
        test = col(c) < F.lit(edge)
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(col(c).isNotNull(), out.otherwise(labels[-1]))


def capped(c: Column | str, most: int) -> Column:
    return F.when(col(c).isNotNull(), F.least(col(c), F.lit(most)))


def capped_label(c: Column | str, most: int) -> Column:
    return F.when(col(c) >= most, f"{most}+").otherwise(col(c).cast("string"))


def sentinel_to_null(c: Column | str, value) -> Column:
    return F.nullif(col(c), F.lit(value))


def month_key(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def month_start(ts: Column | str) -> Column:
    return F.trunc(col(ts).cast("date"), "month")


def is_weekend(ts: Column | str) -> Column:
    return F.dayofweek(col(ts)).isin(1, 7)


def iso_weekday(ts: Column | str) -> Column:
    return F.weekday(col(ts)) + 1


def duration_minutes(start: Column | str, end: Column | str) -> Column:
    """Elapsed minutes with their fraction."""
    seconds = lambda c: F.unix_micros(col(c).cast("timestamp")) / 1e6
    return (seconds(end) - seconds(start)) / 60


def minute_boundaries(start: Column | str, end: Column | str) -> Column:
    """How many full minutes of the clock lie between: 00:00:50 to 00:01:10 is one."""
    minute = lambda c: F.floor(F.unix_seconds(col(c).cast("timestamp")) / 60)
    return minute(end) - minute(start)


def local_time(ts: Column | str, zone: Column | str) -> Column:
    """An instant as the wall clock of a zone; zone is a name or a Column."""
    return F.from_utc_timestamp(col(ts), zone)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def serial_to_timestamp(days: Column | str) -> Column:
    """A spreadsheet's day number (day 0 is 1899-12-30), rounded to the millisecond."""
    return F.timestamp_millis((F.round(col(days).cast("double") * 86_400_000) - 25_569 * 86_400_000).cast("long"))


def surrogate_key(*cols: Column | str) -> Column:
    """md5 of the values joined by '-', null told from empty."""
    return F.md5(F.concat_ws("-", *[F.coalesce(col(c).cast("string"), F.lit("_null_")) for c in cols]))


def date_key(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyyMMdd").cast("int")


#: Segments by recency, frequency and monetary score, in order of precedence.
RFM_SEGMENTS = ("Champions", "Loyal", "New / promising", "At risk", "Lost", "Need attention")


def rfm_segment(r: Column | str, f: Column | str, m: Column | str) -> Column:
    r, f, m = col(r), col(f), col(m)
    tests = ((r >= 4) & (f >= 4) & (m >= 4), (r >= 3) & (f >= 3), (r >= 4) & (f <= 2), (r <= 2) & (f >= 3), (r <= 2) & (f <= 2))
    out = F.lit(RFM_SEGMENTS[-1])
    for test, name in reversed(list(zip(tests, RFM_SEGMENTS, strict=False))):
        out = F.when(test, name).otherwise(out)
    return out


def content_digest(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)
