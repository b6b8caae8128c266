"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

Leaves are (domain, language, source). Bottom-up, each node gets its capacity: the tokens below it times the epochs allowed.
Top-down, each node's budget is dealt to its children by weight; a child takes its capacity at most, and what it leaves goes
to its siblings by weight, so it leaves the subtree only once all siblings are full. Within one family this is solved in one
pass: ordered by capacity per weight, the children that fill up come first.

A leaf's epochs are permutations by md5(seed, epoch, doc_id). Its budget pays for whole epochs and for a prefix of the next:
documents in that order while their running total stays within the rest. Running totals take two steps: totals of hash slices
of a leaf, then a window inside the one slice where the budget ends, so that no leaf is ever sorted in one task.
All arithmetic is on integers, so results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlib.llm.common import materialize, read

#: The target weights in production; what is not named weighs 1.
DOMAIN_WEIGHTS = {"books": 2, "forum": 3, "web": 5}
LANG_WEIGHTS = {"de": 2, "en": 4, "es": 2, "fr": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
#: The budget is BUDGET_PERCENT of all tokens; a document is used MAX_EPOCHS times at most; 4 UTF-8 bytes count as a token.
BUDGET_PERCENT, MAX_EPOCHS, SEED, BYTES_PER_TOKEN = 60, 2, 17, 4
LEVELS = ("domain", "lang", "source")
_D = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The corpus has no domain column: sources are dealt to three by the first digit of their md5."""
    digit = F.substring(F.md5(source), 1, 1)
    return F.when(digit < "5", "web").when(digit < "a", "forum").otherwise("books")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in sorted(weights.items()):
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(BYTES_PER_TOKEN)), F.lit(0)).cast("long")


def _deal(family: DataFrame, parent: list[str], name: str) -> DataFrame:
    """family: parent columns, name, cap, weight, total (the parent's budget). Adds budget: integers, rounded down."""
    cap, weight = F.col("cap").cast(_D), F.col("weight").cast(_D)
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total").cast(_D) - F.coalesce(F.sum(cap).over(before), F.lit(0).cast(_D))
    family = family.withColumns({"left": left.cast(_D), "rest": F.sum(weight).over(from_here).cast(_D)})
    # Full if its share of what is left does not fall short of its capacity; once one child is not full, none after it is.
    full = F.col("cap").cast(_D) * F.col("rest") <= F.col("left") * F.col("weight").cast(_D)
    family = family.withColumn("full", full)
    own = Window.partitionBy(*parent)
    first_open = F.min(F.when(~F.col("full"), F.struct((-F.col("rest")).alias("least"), "left", "rest"))).over(own)
    family = family.withColumn("open_left", first_open)
    share = F.expr("(open_left.left * cast(weight as decimal(10,0))) div open_left.rest")
    return family.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), share.cast("long"))).cast("long")).drop("left", "rest", "full", "open_left", "total")


def budgets(leaves: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights=None) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds budget. Weights are positive integers by level."""
    weights = weights or (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = None
    for k, level in enumerate(LEVELS):
        parent, key = list(LEVELS[:k]), list(LEVELS[: k + 1])
        nodes = caps.groupBy(*key).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight_of(F.col(level), weights[k]))
        if above is None:  # the root's budget; one row for each domain
            every = F.sum(F.col("tokens").cast(_D)).over(Window.partitionBy(F.lit(1)))
            family = nodes.withColumn("every", (every * percent).cast(_D)).withColumn("total", F.expr("cast(every div 100 as bigint)")).drop("every")
        else:
            family = nodes.join(above, parent)
        above = _deal(family, parent or [F.lit(1)], level).select(*key, F.col("budget").alias("total"))
    return leaves.join(above.withColumnRenamed("total", "budget"), list(LEVELS))


def mix(docs: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights=None, slice_docs: int = 256) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies for every row of docs that is used once or more.

    copies: whole epochs of the row's leaf, and one more if it lies in the prefix of the next. Null lang and source are ''.
    Null or empty texts have no tokens and come along with any epoch. Repeated rows share their place in the order and count
    each; ties of the order go by doc_id. Rows without an id are ordered as the text ''. An empty table gives an empty table;
    further columns are ignored.
    """
    slim = docs.select("doc_id", domain_of(F.coalesce("source", F.lit(""))).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), tokens_of(F.col("text")).alias("tokens"))
    slim = materialize(slim, "mix")
    leaf = list(LEVELS)
    leaves = slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    dealt = budgets(leaves, percent, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(max_epochs)).cast("int")
    dealt = dealt.select(*leaf, whole.alias("whole"), F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)).cast("long").alias("rest"), F.greatest(F.lit(1), F.least(F.lit(65536), F.expr(f"docs div {slice_docs}"))).cast("long").alias("slices"))
    dealt = materialize(dealt, "budgets")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = slim.join(dealt, leaf).withColumn("place", order)
    placed = placed.withColumn("slice", F.expr("(conv(substr(place, 1, 8), 16, 10) * slices) div 4294967296L").cast("long"))
    slices = placed.groupBy(*leaf, "slice").agg(F.sum("tokens").alias("in_slice"))
    # slices of a leaf: 65,536 at most
    before = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
    placed = placed.join(starts, [*leaf, "slice"])
    inside = Window.partitionBy(*leaf, "slice").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = ["doc_id", *leaf, "tokens"]
    certain = F.when(F.col("start") + F.col("in_slice") <= F.col("rest"), 1).when(F.col("start") > F.col("rest"), 0)
    known = placed.withColumn("extra", certain).where("extra IS NOT NULL")
    partial = placed.where(certain.isNull()).withColumn("extra", (F.col("start") + F.sum("tokens").over(inside) <= F.col("rest")).cast("int"))
    both = known.select(*columns, "whole", "extra").unionByName(partial.select(*columns, "whole", "extra"))
    extra = F.when((F.col("tokens") == 0) | (F.col("whole") >= max_epochs), 0).otherwise(F.col("extra"))
    return both.select(*columns, (F.col("whole") + extra).cast("long").alias("copies")).where("copies > 0")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return mix(read(spark, sf_dir, "documents"))


_NODE = """
{n}c AS (SELECT {keys}, sum(cap) AS cap, any_value({w})::HUGEINT AS weight FROM leaves GROUP BY {keys}),
{n}t AS (SELECT c.*, a.total FROM {n}c c JOIN {above} a {on}),
{n}w AS (SELECT *, total - coalesce(sum(cap) OVER (PARTITION BY {part} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
                sum(weight) OVER (PARTITION BY {part} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst FROM {n}t),
{n}o AS (SELECT *, cap * rst <= lft * weight AS full_, max(CASE WHEN cap * rst > lft * weight THEN rst END) OVER (PARTITION BY {part}) AS orst FROM {n}w),
{n}l AS (SELECT *, max(CASE WHEN rst = orst AND NOT full_ THEN lft END) OVER (PARTITION BY {part}) AS olft FROM {n}o),
{n} AS (SELECT {keys}, (CASE WHEN full_ THEN cap ELSE least(cap, (olft * weight) // orst) END)::HUGEINT AS total FROM {n}l)"""


def _sql_case(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 1 END" if weights else "1"


#: The same in DuckDB, with one window over each leaf.
ORACLE_SQL = (
    f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '5' THEN 'web' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'a' THEN 'forum' ELSE 'books' END AS domain,
                  ((coalesce(strlen(text), 0) + {BYTES_PER_TOKEN - 1}) // {BYTES_PER_TOKEN})::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
root AS (SELECT (sum(tokens) * {BUDGET_PERCENT}) // 100 AS total FROM leaves),"""
    + ",".join(
        _NODE.format(n=n, keys=", ".join(LEVELS[: k + 1]), name=LEVELS[k], part=", ".join(LEVELS[:k]) or "1", above=above, on="ON true" if k == 0 else f"USING ({', '.join(LEVELS[:k])})", w=_sql_case(LEVELS[k], w))
        for k, (n, above, w) in enumerate((("na", "root", DOMAIN_WEIGHTS), ("nb", "na", LANG_WEIGHTS), ("nc", "nb", SOURCE_WEIGHTS)))
    )
    + f""",
b AS (SELECT domain, lang, source, tokens AS all_, total, CASE WHEN tokens > 0 THEN total // tokens ELSE {MAX_EPOCHS} END AS whole, CASE WHEN tokens > 0 THEN total % tokens ELSE 0 END AS rest
      FROM leaves JOIN nc USING (domain, lang, source)),
p AS (SELECT d.*, whole, rest, md5('{SEED}|' || whole::BIGINT::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')) AS place FROM d JOIN b USING (domain, lang, source)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT doc_id, domain, lang, source, tokens, (whole + CASE WHEN tokens > 0 AND whole < {MAX_EPOCHS} AND run <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r
WHERE whole + CASE WHEN tokens > 0 AND whole < {MAX_EPOCHS} AND run <= rest THEN 1 ELSE 0 END > 0
"""
)
