"""Importance resampling towards a target distribution, over the distinct lines of a corpus.

A text's features are its runs of 1 to `most` consecutive words, hashed to buckets. Both corpora give counts by bucket, and a
bucket's gain says how much likelier it is in the target. A document's weight is the mean gain of its features; a draw without
replacement takes the greatest sums of weight and Gumbel noise, the noise being a hash of the id.

Newlines are separators, so they cut a text into lines, and no word crosses one. The buckets of each distinct line are worked
out once: its occurrences multiply what it adds to the counts, and all documents that hold it share its gain. Runs that cross
lines belong to no line; they are taken from whole texts, and added separately.

In Spark: lines are grouped with a partial count before the shuffle. Documents find their lines by two 64-bit hashes. A line with
over a HOT-th of all occurrences is broadcast (there are HOT of them at most), the others are joined by shuffle. Ranks come
from a range partition, so no task holds all documents. The driver holds counts by bucket, and nothing by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.common import map_texts, materialize, read
from martlib.sources.scratch import in_ranges, range_starts

#: The query's parameters: longest run of words, buckets, seed, least words of a document that can be drawn, per cent drawn.
MOST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: A line with over one in HOT of all occurrences is hot.
HOT = 1000
#: Bytes of a text whose words are Python objects at the same time.
PIECE = 1 << 20

#: Bytes of words: 0-9, a-z and all of characters beyond ASCII; A-Z become a-z, all else separates.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_in_pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a piece of about PIECE bytes at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE)
        end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end


def _bucket_of(words: list[bytes], buckets: int, known: dict[bytes, int]) -> list[int]:
    return [known[w] if w in known else known.setdefault(w, zlib.crc32(w) % buckets) for w in words]


def features(text: str, most: int, buckets: int, known: dict[bytes, int], lines: bool = False) -> tuple[int, np.ndarray]:
    """(words, buckets of all runs of 1 to most words). lines: only of runs that cross a newline."""
    count, found, tail = 0, [], []  # tail: (word, line) of the last most - 1 words
    line = 0
    for part in text.split("\n") if lines else [text]:
        for words in words_in_pieces(part):
            count += len(words)
            if not lines:
                found.append(np.array(_bucket_of(words, buckets, known), "<u4"))
            if most > 1:
                held = tail + [(w, line) for w in words]
                made = []
                for end in range(len(tail), len(held)):
                    for start in range(end - 1, max(-1, end - most), -1):
                        if not lines or held[start][1] != held[end][1]:
                            made.append(zlib.crc32(b" ".join([w for w, _ in held[start : end + 1]])) % buckets)
                found.append(np.array(made, "<u4"))
                tail = held[-(most - 1) :]
        line += 1
    return count, np.concatenate(found) if found else np.zeros(0, "<u4")


#: Words whose buckets a task remembers.
_KNOWN = 200_000


def _features_of(most: int, buckets: int, lines: bool) -> Callable[[], Callable[[list], list[list]]]:
    def make() -> Callable[[list], list[list]]:
        known: dict[bytes, int] = {}

        def work(texts: list) -> list[list]:
            if len(known) > _KNOWN:
                known.clear()
            made = [features(t or "", most, buckets, known, lines) for t in texts]
            return [[n for n, _ in made], [b.tobytes() for _, b in made]]

        return work

    return make


_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())]
_KEYS = ["a", "b"]


def _line_keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b")]


def line_features(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """(a, b, times, n_words, buckets) of each distinct line of the column text that is not empty, written to the shared folder:
    hashes, occurrences, words, and the bucket of each feature as 32-bit numbers."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("times"))
    return materialize(map_texts(lines.select(*_line_keys(F.col("line")), "times", "line"), "line", _ADDED, _features_of(most, buckets, False), drop=("line",)), "lines")


def crossing_features(texts: DataFrame, most: int, buckets: int) -> DataFrame | None:
    """(row, buckets) of the runs that cross lines, by row of texts (row, text); None if runs are single words, as none cross."""
    if most == 1:
        return None
    some = texts.where(F.contains("text", F.lit("\n")))
    return materialize(map_texts(some.select("row", "text"), "text", _ADDED, _features_of(most, buckets, True), drop=("text",)).drop("n_words"), "crossing")


def bucket_counts(parts: list[DataFrame], buckets: int) -> np.ndarray:
    """How many features fall in each bucket, of frames (times, buckets). A row for each task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            times = b.column("times").to_numpy()
            cells = [np.frombuffer(x, "<u4") for x in b.column("buckets").to_pylist()]
            if cells:
                total += np.bincount(np.concatenate(cells), np.repeat(times, [len(c) for c in cells]), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for part in parts:
        for r in part.select("times", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
            out[r["bucket"]] += r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the log of its smoothed share in the target over that in the source, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _gained(parts: DataFrame, gains: np.ndarray) -> DataFrame:
    """parts with n_features and gain, the sum of its features' gains, in place of buckets."""
    kept = [f for f in parts.schema.fields if f.name != "buckets"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [np.frombuffer(x, "<u4") for x in b.column("buckets").to_pylist()]
            made = [pa.array([len(c) for c in cells], pa.int64()), pa.array([int(gains[c].sum()) for c in cells], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *made], names=[*names, "n_features", "gain"])

    return parts.mapInArrow(run, T.StructType([*kept, T.StructField("n_features", T.LongType()), T.StructField("gain", T.LongType())]))


def _by_line(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """(row, n_words, n_features, gain) for each line of each document. Hot lines meet the documents by broadcast."""
    total = lines.agg(F.sum("times")).first()[0] or 0
    columns = ["row", "n_words", "n_features", "gain"]
    hot, others = lines.where(F.col("times") * HOT > total), lines.where(F.col("times") * HOT <= total)
    pairs = materialize(keyed.select("row", F.explode("lines").alias("k")).select("row", "k.*"), "pairs")
    by_hot = pairs.join(F.broadcast(hot), _KEYS).select(*columns)
    return by_hot.unionByName(pairs.join(F.broadcast(hot.select(*_KEYS)), _KEYS, "left_anti").join(others, _KEYS).select(*columns))


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight) for each row of docs (key, text); target: a column text.

    weight: the mean gain of the row's features, rounded down; 0 without features. Null texts have no features. Repeated rows,
    rows of one key and rows without one each count and give a row. An empty target leaves smoothing alone. Further columns
    are ignored. Texts are taken whole; a line is handled in pieces of about PIECE bytes.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    whole = materialize(numbered, "texts") if most > 1 else numbered  # rows have to keep their numbers where texts are read again
    keys = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.struct(*_line_keys(x)))
    keyed = materialize(whole.select("row", "key", keys.alias("lines")), "keyed")
    lines, crossing = line_features(docs.select("text"), most, buckets), crossing_features(whole, most, buckets)
    aims = target.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    aim_lines, aim_crossing = line_features(aims, most, buckets), crossing_features(aims, most, buckets)
    once = lambda c: [] if c is None else [c.withColumn("times", F.lit(1).cast("long"))]
    gains = gains_of(bucket_counts([lines, *once(crossing)], buckets), bucket_counts([aim_lines, *once(aim_crossing)], buckets))

    scored = materialize(_gained(lines, gains), "scored")
    parts = _by_line(keyed, scored)
    if crossing is not None:
        parts = parts.unionByName(_gained(crossing, gains).withColumn("n_words", F.lit(0).cast("long")))
    none = F.lit(0).cast("long")
    rows = keyed.select("row", "key", none.alias("n_words"), none.alias("n_features"), none.alias("gain")).unionByName(parts, allowMissingColumns=True)
    sums = rows.groupBy("row").agg(F.max("key").alias(key), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    down = F.expr("(gain - pmod(gain, n_features)) div n_features")
    return sums.select(key, "n_words", "n_features", F.when(F.col("n_features") > 0, down).otherwise(0).cast("long").alias("weight"))


def add_score(weighed: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Append score: weight plus a thousand times Gumbel noise, rounded down, from sha256 of '<seed>:<key>' (a null key is '')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share))))


def draw(scored: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the drawn percentage (rounded down) of rows with least_words words or more, by score,
    then by key; null for all others. Rows without a key come last among equal scores."""
    able = F.col("n_words") >= least_words
    packed = scored.select(F.struct(*[F.col(f"`{c}`") for c in scored.columns]).alias("doc"), able.alias("able"), F.when(able, F.col("score")).alias("at"), F.col(key).alias("tie"), F.monotonically_increasing_id().alias("row"))
    ranged = in_ranges(packed, [F.desc_nulls_last("at"), F.asc_nulls_last("tie"), F.col("row")], "ranks")
    drawn = ranged.agg(F.expr(f"count_if(able) * {percent} div 100").alias("__drawn"))
    placed = ranged.join(F.broadcast(range_starts(ranged, F.count("*"))), "__part").crossJoin(F.broadcast(drawn))
    number = F.col("__start") + F.col("__at") + 1
    return placed.select("doc.*", F.when(number <= F.col("__drawn"), number).cast("long").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, towards the benchmark's texts."""
    weighed = weigh(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return draw(add_score(weighed)).select("doc_id", "n_features", "weight", "score", "rank")


_COUNTED = """
{n}w AS (SELECT {id}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM {table})"""
#: The same in DuckDB, word by word. It has no CRC-32: a table by the polynomial, and a fold over each distinct word's bytes.
ORACLE_SQL = (
    "WITH "
    + ",".join(_COUNTED.format(n=n, id=i, table=t) for n, i, t in (("s", "row", "(SELECT row_number() OVER () AS row, text FROM documents)"), ("t", "0 AS row", "benchmark")))
    + f""",
crc AS (SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(b))),
words AS MATERIALIZED (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM sw UNION SELECT word FROM tw)),
bytes AS (SELECT word, list_transform(range(1, len(h) // 2 + 1), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1) AS b FROM words),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
sc AS (SELECT bucket, count(*) AS s FROM sw JOIN hashed USING (word) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM tw JOIN hashed USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM sw) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM tw) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sc LEFT JOIN tc USING (bucket)),
f AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS gain FROM sw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY row),
d AS (SELECT row_number() OVER () AS row, doc_id FROM documents),
w AS (SELECT row, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (row)),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM w),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () * {PERCENT} // 100 AS drawn FROM x WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM x LEFT JOIN r USING (row)
"""
)
