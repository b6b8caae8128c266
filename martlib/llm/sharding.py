"""Sharding along a Hilbert curve, so that files can be pruned by several metadata columns.

Each dimension is quantised to 2**BITS cells: text by shares of the rows (the distinct values are counted and summed up in
order), lengths likewise by classes of a quarter of a doubling, ids in equal steps from the least to the greatest. The index of a row's
cell along a Hilbert curve (J. Skilling's transposed form, 2004) orders the rows, and the order is cut into runs. Neighbours on
the curve are neighbours in every dimension, so a shard covers a small box of the metadata, and a reader that filters on any
of the dimensions skips the shards (and the row groups within one) whose least and greatest values lie outside.

Runs are cut by one of two laws. `rows`: numbers of rows differ by one at most. `bytes`: a row goes to the shard in which
the middle of its bytes falls, so a shard is off an equal share by one row's bytes at most.

In Spark: one range partition along the curve, ties broken by a digest and the id, and a prefix sum over ranges. A cell that
holds most rows is split by its ties.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martlib.llm.common import read
from martlib.sources.scratch import in_ranges, range_starts

#: Shards of the query, bits of a dimension, bytes of a row besides its text.
SHARDS, BITS, ROW_BYTES = 24, 4, 8
CELLS = 1 << BITS


def hilbert_index(axes: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index along the curve of points whose coordinates are integers under 2**bits; len(axes) * bits is 63 at most."""
    x, last = [np.asarray(a, np.int64).copy() for a in axes], len(axes) - 1
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            x[i] ^= swap if i else 0
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[last] & q) != 0, q - 1, 0)
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = (index << 1) | (((a ^ turn) >> b) & 1)
    return index


def curve(cells: list[Column], bits: int = BITS) -> Column:
    """hilbert_index of integer columns."""

    @F.pandas_udf("long")
    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    return index(*cells)


def share_cells(df: DataFrame, c: Column, cells: int = CELLS) -> Column:
    """A column of numbers under `cells`: how many cells' worth of rows have smaller values. Every row with one value has one
    cell. Values that begin a cell are collected, fewer than `cells` of them."""
    counts = df.groupBy(c.alias("value")).agg(F.count("*").alias("n"))
    ranged = in_ranges(counts, ["value"], "values")
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ranged.withColumn("__in", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(range_starts(ranged, F.sum("n"))), "__part")
    total = ranged.agg(F.sum("n").alias("__total"))
    cell = F.expr(f"cast((cast(__start + __in as decimal(38,0)) * {cells}) div __total as int)")
    begins = before.crossJoin(F.broadcast(total)).groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).orderBy("cell").collect()
    out = F.lit(0)
    for r in begins:  # the last one that fits holds
        out = F.when(c >= F.lit(r["value"]), r["cell"]).otherwise(out) if r["cell"] else out
    return out


def step_cells(df: DataFrame, c: Column, cells: int = CELLS) -> Column:
    """A column of numbers under `cells`, in equal steps from the least value to the greatest. c: integers without nulls."""
    r = df.agg(F.min(c).alias("low"), F.max(c).alias("high")).first()
    low, high = r["low"] or 0, r["high"] or 0
    whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    return F.call_function("div", (c.cast("decimal(20,0)") - whole(low)) * whole(cells), whole(high - low + 1)).cast("int")


def size_class(n: Column) -> Column:
    """Four classes for each doubling of a positive number: its binary digits, and the two bits after the first."""
    digits = F.length(F.bin(n))
    return 4 * digits + F.call_function("shiftright", 8 * n, digits).bitwiseAND(F.lit(3).cast("long"))


def shard_rows(df: DataFrame, cells: list[Column], ties: list[Column], size: Column, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """df with shard (from 0) and slot (from 0 within its shard, without gaps), along the curve of the given cells.

    ties order rows of one cell, and rows that are still equal fall anyhow. Columns shard and slot of df are replaced; all others pass,
    whatever their names. Fewer rows than shards leave shards empty. An empty table gives an empty table.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]
    names = [f"tie{k}" for k in range(len(ties))]
    packed = df.select(F.struct(*kept).alias("doc"), curve(cells).alias("at"), *[t.alias(n) for t, n in zip(ties, names, strict=True)], size.cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    ranged = in_ranges(packed, ["at", *[F.asc_nulls_last(n) for n in names], "row"], "curve")
    starts = range_starts(ranged, F.count("*")).withColumnRenamed("__start", "__rows")
    total = ranged.agg(F.count("*").alias("__n"), F.sum(F.col("size").cast("decimal(38,0)")).alias("__bytes"))
    placed = ranged.join(F.broadcast(starts), "__part").crossJoin(F.broadcast(total))
    number = F.col("__rows") + F.col("__at")
    if law == "rows":
        shard = F.expr(f"((__rows + __at) * {shards}) div __n")
        first = F.expr(f"(shard * __n + {shards - 1}) div {shards}")  # the first number that falls in the shard
        return placed.withColumn("shard", shard).select("doc.*", F.col("shard").cast("int").alias("shard"), (number - first).alias("slot"))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bytes_ = range_starts(ranged, F.sum("size")).withColumnRenamed("__start", "__before")
    placed = placed.join(F.broadcast(bytes_), "__part").withColumn("__upto", F.col("__before") + F.sum("size").over(inside))
    middle = (2 * F.col("__upto") - F.col("size")).cast("decimal(38,0)")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("__bytes")))).cast("int")).withColumn("number", number)
    first = placed.groupBy("shard").agg(F.min("number").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc.*", "shard", (F.col("number") - F.col("first")).alias("slot"))


def document_cells(docs: DataFrame) -> list[Column]:
    """Language, source (null: '') and class of the text's bytes by shares, id in steps (null: 0)."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    size = size_class(text_bytes(F.col("text")) + 1)
    return [share_cells(docs, lang), share_cells(docs, source), share_cells(docs, size), step_cells(docs, F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"))]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """docs (doc_id, text, lang, source and any other columns) with shard and slot. Null texts have no bytes; texts that are equal
    stand next to each other within a cell; rows without an id come last among them. Repeated rows each have a slot."""
    ties = [F.md5(F.coalesce("text", F.lit(""))), F.col("doc_id")]
    return shard_rows(docs, document_cells(docs), ties, text_bytes(F.col("text")) + ROW_BYTES, shards, law)


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, rows in the order of the curve, so that row groups can be skipped as well."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, with size and digest of its text; numbers of rows are at most one apart."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    text = F.col("text")
    slim = docs.select("doc_id", (text_bytes(text) + ROW_BYTES).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), *[c.alias(f"c{k}") for k, c in enumerate(document_cells(docs))])
    out = shard_rows(slim, [F.col(f"c{k}") for k in range(4)], [F.col("digest"), F.col("doc_id")], F.col("size"), SHARDS, "rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _xor(*terms: str) -> str:
    out = terms[0]
    for t in terms[1:]:
        out = f"xor({out}, {t})"
    return out


def _curve_sql() -> str:
    """Chained CTEs from h0 (x0 to x3) to placed (spot): the transform above."""
    steps, qs, k = [], [1 << b for b in range(BITS - 1, 0, -1)], 0
    for q in qs:
        for i in range(4):
            swap = f"CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE xor(x0, x{i}) & {q - 1} END"
            first = f"xor(x0, CASE WHEN x{i} & {q} <> 0 THEN {q - 1} ELSE xor(x0, x{i}) & {q - 1} END) AS x0"
            steps.append(f"h{k + 1} AS (SELECT * REPLACE ({first}{f', xor(x{i}, {swap}) AS x{i}' if i else ''}) FROM h{k})")
            k += 1
    gray = f"SELECT * REPLACE ({', '.join(f'{_xor(*[f"x{j}" for j in range(i + 1)])} AS x{i}' for i in range(1, 4))}) FROM h{k}"
    turn = _xor(*[f"CASE WHEN x3 & {q} <> 0 THEN {q - 1} ELSE 0 END" for q in qs])
    index = " + ".join(f"((xor(x{i}, turn) >> {b}) & 1) * {1 << (4 * b + 3 - i)}" for b in range(BITS) for i in range(4))
    return f"{', '.join(steps)}, gray AS ({gray}), turned AS (SELECT *, {turn} AS turn FROM gray), placed AS (SELECT *, {index} AS spot FROM turned)"


def _shares_sql(table: str, c: str) -> str:
    return f"{c}_cells AS (SELECT {c}, ((sum(n) OVER (ORDER BY {c}) - n) * {CELLS} // sum(n) OVER ())::INTEGER AS cell FROM (SELECT {c}, count(*) AS n FROM {table} GROUP BY {c}))"


def _steps_sql(c: str) -> str:
    return f"(({c}::HUGEINT - min({c}::HUGEINT) OVER ()) * {CELLS} // (max({c}::HUGEINT) OVER () - min({c}::HUGEINT) OVER () + 1))::INTEGER"


#: The same in DuckDB, with one window over all rows. It has no CRC-32: a table by the polynomial, folded over each text's bytes.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 0) AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(b))),
bytes AS (SELECT doc_id, id, text, lang, source, n, list_transform(regexp_extract_all(h, '..'), lambda p: 16 * (strpos('0123456789ABCDEF', p[1]) - 1) + strpos('0123456789ABCDEF', p[2]) - 1) AS b FROM d),
hashed AS MATERIALIZED (SELECT * EXCLUDE (b, t, text), md5(text) AS digest, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32, 4 * length(bin(n + 1)) + ((8 * (n + 1) >> length(bin(n + 1))) & 3) AS size_class FROM bytes, crc),
{_shares_sql('d', 'lang')}, {_shares_sql('d', 'source')}, {_shares_sql('hashed', 'size_class')},
h0 AS (SELECT doc_id, n, digest, text_crc32, l.cell AS x0, s.cell AS x1, z.cell AS x2, {_steps_sql('id')} AS x3 FROM hashed JOIN lang_cells l USING (lang) JOIN source_cells s USING (source) JOIN size_class_cells z USING (size_class)),
{_curve_sql()},
numbered AS (SELECT *, row_number() OVER (ORDER BY spot, digest, doc_id NULLS LAST) - 1 AS number, count(*) OVER () AS every FROM placed),
cut AS (SELECT *, number * {SHARDS} // every AS shard FROM numbered)
SELECT doc_id, n + {ROW_BYTES} AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, number - (shard * every + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM cut
"""
