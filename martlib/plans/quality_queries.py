"""Verdicts, checks and reconciliation on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlib.functions import columns as C
from martlib.operators import aggregates as A
from martlib.operators import clean as P
from martlib.operators import quality as Q
from martlib.plans.shop_queries import _VERSIONS, SALES, sales, versions
from martlib.sources.readers import explode_parallel_arrays, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _line_rules():
    return [
        ("no quantity", F.col("l_quantity") <= 0), ("tax above 7 %", F.col("l_tax") > 0.07),
        ("discount of 10 %", F.col("l_discount") >= 0.1), ("returned", F.col("l_returnflag") == "R"),
    ]


_VERDICT = "CASE WHEN l_quantity <= 0 THEN 'no quantity' WHEN l_tax > 0.07 THEN 'tax above 7 %' WHEN l_discount >= 0.1 THEN 'discount of 10 %' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'ok' END"


@query(f"SELECT quality, count(*) AS rows, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share_pct FROM (SELECT {_VERDICT} AS quality FROM lineitem) GROUP BY 1")
def quality_report(spark, d):
    return A.quality_report(P.quality_verdict(table(spark, d, "lineitem"), _line_rules()))


@query("""SELECT 'no quantity' AS rule, count(*) FILTER (WHERE l_quantity <= 0) AS violations FROM lineitem UNION ALL SELECT 'tax above 7 %', count(*) FILTER (WHERE l_tax > 0.07) FROM lineitem
UNION ALL SELECT 'discount of 10 %', count(*) FILTER (WHERE l_discount >= 0.1) FROM lineitem UNION ALL SELECT 'returned', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem""")
def rule_counts(spark, d):
    return A.rule_counts(table(spark, d, "lineitem"), _line_rules())


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, {_VERDICT} AS quality FROM lineitem WHERE {_VERDICT} <> 'ok'")
def rejected_lines(spark, d):
    _, bad = P.split_by_verdict(P.quality_verdict(table(spark, d, "lineitem"), _line_rules()))
    return bad.select("l_orderkey", "l_partkey", "l_linenumber", "quality")


@query("""SELECT kind, count(*) AS lines, sum(q)::BIGINT AS units FROM (SELECT l_quantity - 25 AS q, CASE WHEN l_returnflag = 'R' THEN 'cancellation' WHEN l_quantity - 25 < 0 THEN 'stock_adjustment' ELSE 'sale' END AS kind FROM lineitem) WHERE q <> 0 GROUP BY 1""")
def line_type_summary(spark, d):
    lines = table(spark, d, "lineitem").select((F.col("l_quantity") - 25).alias("q"), F.when(F.col("l_returnflag") == "R", "C1").otherwise("1").alias("invoice"), F.lit(1.0).alias("price"))
    kept = lines.where(~C.is_rejected("q", "price"))
    return kept.groupBy(C.line_type("invoice", "q").alias("kind")).agg(F.count("*").alias("lines"), F.sum("q").cast("bigint").alias("units"))


@query(f"""WITH {SALES}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE quantity >= 5) AS k, count(*) FILTER (WHERE quantity < 5) AS j, sum(revenue) AS rm, sum(revenue) FILTER (WHERE quantity >= 5) AS fm, sum(revenue) FILTER (WHERE quantity < 5) AS jm FROM s)
SELECT 'every line is loaded or rejected' AS check_name, 'critical' AS severity, n = k + j AS passed, (n - k - j)::DOUBLE AS observed FROM n UNION ALL SELECT 'revenue reconciles', 'critical', rm = fm + jm, (rm - fm - jm)::DOUBLE FROM n
UNION ALL SELECT 'the load is not empty', 'critical', n > 0, n::DOUBLE FROM n""")
def reconcile_layers(spark, d):
    s = sales(spark, d)
    return Q.load_reconciles(s, s.where("quantity >= 5"), s.where("quantity < 5"))


@query("""SELECT 'parts known' AS reference, count(*) AS orphans FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) UNION ALL
SELECT 'orders known', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def fk_orphans(spark, d):
    lines = table(spark, d, "lineitem")
    n = lambda name, df: df.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("reference"), "orphans")
    parts = Q.orphans(lines, table(spark, d, "part").where("p_size <= 40"), "l_partkey", "p_partkey")
    orders = Q.orphans(lines, table(spark, d, "orders").where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey")
    return n("parts known", parts).unionByName(n("orders known", orders))


@query("""SELECT 'l_orderkey is not null' AS check_name, 'critical' AS severity, count(*) FILTER (WHERE l_orderkey IS NULL) = 0 AS passed, (count(*) FILTER (WHERE l_orderkey IS NULL))::DOUBLE AS observed FROM lineitem
UNION ALL SELECT 'l_returnflag has accepted values', 'critical', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) = 0, (count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')))::DOUBLE FROM lineitem
UNION ALL SELECT 'l_discount in range', 'critical', count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) = 0, (count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05))::DOUBLE FROM lineitem
UNION ALL SELECT 'l_linenumber is unique', 'critical', count(l_linenumber) = count(DISTINCT l_linenumber), (count(l_linenumber) - count(DISTINCT l_linenumber))::DOUBLE FROM lineitem
UNION ALL SELECT 'tax below discount', 'warn', count(*) FILTER (WHERE NOT l_tax < l_discount) = 0, (count(*) FILTER (WHERE NOT l_tax < l_discount))::DOUBLE FROM lineitem""")
def table_checks(spark, d):
    """Five checks of one table in one pass."""
    return Q.run_checks(table(spark, d, "lineitem"), [
        Q.not_null("l_orderkey"), Q.accepted_values("l_returnflag", ["A", "N"]), Q.in_range("l_discount", 0, 0.05), Q.unique("l_linenumber"),
        Q.holds("tax below discount", F.col("l_tax") < F.col("l_discount"), severity="warn"),
    ])


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return Q.unique_combination(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT 'order totals' AS check_name, 'critical' AS severity, abs(a - b) <= 0 AS passed, abs(a - b)::DOUBLE AS observed FROM (SELECT sum(l_quantity)::BIGINT AS a FROM lineitem), (SELECT count(*) AS b FROM lineitem)""")
def sums_match(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint").alias("q"))
    return Q.sum_equals_rows(lines, "q", lines, "order totals")


@query(f"WITH {_VERSIONS} SELECT count(*) AS keys_without_one_current FROM (SELECT o_custkey FROM v GROUP BY 1 HAVING sum(is_current::INT) <> 1)")
def one_current(spark, d):
    return Q.one_current_version(versions(spark, d), "o_custkey").agg(F.count("*").alias("keys_without_one_current"))


@query("""SELECT c_mktsegment AS segment, year(o_orderdate)::INT AS year, count(*) AS orders, round(100 * avg((o_orderstatus = 'F')::INT), 1) AS finished_pct FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def finished_by_segment(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), C.pct(F.col("o_orderstatus") == "F").alias("finished_pct"))


@query("""WITH s AS (SELECT source, lang, quality, toxic FROM documents JOIN labels USING (doc_id)), u AS (SELECT 'source' AS dimension, source AS segment, quality, toxic FROM s UNION ALL SELECT 'lang', lang, quality, toxic FROM s)
SELECT dimension, segment, count(*) AS docs, round(100 * avg(quality), 1) AS good_pct, round(100 * avg(toxic), 1) AS toxic_pct FROM u GROUP BY ALL""")
def label_quality_by_source(spark, d):
    from martlib.operators.joins import labelled_slices

    j = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    s = labelled_slices(j, {"source": "source", "lang": "lang"}, ["quality", "toxic"])
    return s.groupBy("dimension", "segment").agg(F.count("*").alias("docs"), F.round(100 * F.avg("quality"), 1).alias("good_pct"), F.round(100 * F.avg("toxic"), 1).alias("toxic_pct"))


@query("""SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings""")
def array_explode(spark, d):
    e = table(spark, d, "embeddings").withColumn("at", F.sequence(F.lit(0), F.size("embedding") - 1))
    return explode_parallel_arrays(e.select("vec_id", "embedding", "at"), {"pos": "at", "v": "embedding"}).select("vec_id", "pos", F.col("v").cast("double").alias("x"))


@query("""SELECT s_suppkey, metric, value FROM (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nationkey FROM supplier) UNPIVOT (value FOR metric IN (s_acctbal, s_nationkey))""")
def supplier_metrics(spark, d):
    return A.unpivot(table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey")), ["s_suppkey"], ["s_acctbal", "s_nationkey"])


@query("""SELECT o_orderpriority AS symbol, count(*) AS docs, md5(o_orderpriority || '-' || count(*)) AS key FROM orders GROUP BY 1""")
def surrogate_keys(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.count("*").alias("docs"))
    return g.withColumn("key", C.surrogate_key("symbol", "docs"))

