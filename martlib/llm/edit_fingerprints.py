"""Document fingerprints by a randomised edit embedding (Chakraborty, Goldenberg and Koucky, 2016).

A shared random walk reads a text: at step j it stands on a character, and a random bit that depends on j and on that
character alone says whether it moves on. After an edit two walks soon fall back into step (most of the time: how long it takes
has a heavy tail, so WALKS walks share the work), and the edit distance of texts becomes a Hamming distance of walks. A
fingerprint samples steps of the walks, the same steps for all texts: a shared hash deals the steps into bins and gives each a
rank, and each bin keeps a byte for the two characters at which the walk stood at its step of the lowest rank. A text of
any length is sampled over its whole walk; walks of different lengths have the lowest-ranked step of a bin in common as often
as the shorter one's length is to the longer one's. Likeness is the share of bins that agree. Texts that agree on all bins of
a band are candidates, and whole fingerprints verify them (similar_documents).

The walk is sequential in a text, so numpy walks many texts abreast, one step at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.buckets import links_in_buckets
from martlib.llm.common import map_texts, materialize, read, small_batches

BANDS, ROWS, CLASSES, PERIOD, WALKS, SEED = 32, 4, 256, 4096, 2, 11
BINS = BANDS * ROWS
#: Likeness at which documents are linked: nine in ten pairs reach it that are within two per cent of their length in edits.
LIKE = 0.6
OF_WALK = BINS // WALKS
#: Code points of the texts that a task holds and walks abreast (a longer text walks alone).
ABREAST = 16_000_000
#: Bytes of a range of ids: the root of all bytes times RANGE_UNIT, RANGE_MOST at most; what a row counts for besides its text.
RANGE_UNIT, RANGE_MOST, ROW_BYTES = 1 << 19, 1 << 28, 2048
_END, _BLOCK, _LEAST = np.zeros(1, np.uint8), 64, -(1 << 63)


def _tables():
    moves = np.random.default_rng(SEED).integers(0, 2, (WALKS, PERIOD, CLASSES), dtype=np.int64)
    moves[:, :, 0] = 0  # class 0: the end, where the pointer stays
    return moves


MOVES = _tables()


def _steps(walk: int, start: int) -> tuple[list[int], list[int]]:
    """The bin and the rank of each of _BLOCK steps of a walk from start on."""
    with np.errstate(over="ignore"):
        x = (np.arange(start, start + _BLOCK, dtype=np.uint64) * np.uint64(WALKS) + np.uint64(walk + SEED)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
    return (x % np.uint64(OF_WALK)).tolist(), (x >> np.uint64(16)).tolist()


def classes(text: str) -> np.ndarray:
    """Characters as classes 1 to 255."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return (code % np.uint32(CLASSES - 1) + np.uint32(1)).astype(np.uint8)


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, BINS) bytes. A bin that no step fell into takes the next one's byte; an empty text has zeros only."""
    n = len(texts)
    codes = [classes(t) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate([x for c in codes for x in (c, _END)]) if n else _END
    del codes
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if n else sizes
    two = np.zeros(len(flat), np.uint8)  # a character and the next one as 1 to 255
    two[:-1] = (flat[:-1].astype(np.uint32) * 263 + flat[1:]) % 255 + 1
    out = np.concatenate([_walk(w, flat, two, first, sizes) for w in range(WALKS)])
    for _ in range(BINS):
        empty = (out == 0) & (sizes > 0)
        if not empty.any():
            break
        out = np.where(empty, np.roll(out, -1, axis=0), out)
    return out.T


def _walk(walk: int, flat: np.ndarray, two: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(OF_WALK, texts) bytes that one walk leaves; 0 where no step fell."""
    out = np.zeros((OF_WALK, len(sizes)), np.uint8)
    live = np.flatnonzero(sizes)
    pos, end = first[live], (first + sizes)[live]
    sig, lowest, j = np.zeros((OF_WALK, len(live)), np.uint8), [1 << 64] * OF_WALK, 0
    moves = MOVES[walk]
    while len(live):
        bins, ranks = _steps(walk, j)
        for k in range(_BLOCK):
            c = flat.take(pos)
            if ranks[k] < lowest[bins[k]]:
                lowest[bins[k]] = ranks[k]
                np.copyto(sig[bins[k]], two.take(pos), where=c > 0)  # walks that are over keep what they have
            pos += moves[(j + k) % PERIOD].take(c)
        j += _BLOCK
        over = pos >= end
        if (gone := int(over.sum())) == len(live) or 8 * gone > len(live):  # arrays shrink in few, growing steps
            out[:, live[over]] = sig[:, over]
            live, pos, end, sig = live[~over], pos[~over], end[~over], np.ascontiguousarray(sig[:, ~over])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def shared_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).reshape(-1, BANDS, ROWS).all(axis=2).sum(axis=1)


def add_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Append fingerprint (hex). Null counts as empty; equal texts have equal fingerprints; an input column of that name is replaced."""
    work = lambda texts: [[f.tobytes().hex() for f in fingerprints([t or "" for t in texts])]]
    return map_texts(df, text, [T.StructField("fingerprint", T.StringType())], lambda: work)


def similar_documents(prints: DataFrame, least: float = LIKE, key: str = "doc_id") -> DataFrame:
    """(a, b, likeness): links between documents (columns key, fingerprint) that share a band, verified on all bins. They connect
    the same documents as all links of likeness least or more would, between documents that share a band.

    Documents of one fingerprint are linked to the least key among them, which alone stands for them further on. In each
    band's bucket every two members meet, in groups of bounded size (links_in_buckets). At a likeness of 0.8 or more 25 of
    the bins differ at most, so of 32 bands 7 agree or more and no pair escapes; at 0.6 one pair in 80 shares no band. Edits
    put walks out of step for a while, so likeness is lower than the share of characters that two texts have in common. Null
    keys are left out.
    """
    known = prints.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "fingerprint")
    one = known.groupBy("fingerprint").agg(F.min("key").alias("key"))
    equal = known.withColumnRenamed("key", "b").join(one.withColumnRenamed("key", "a"), "fingerprint").where("a <> b").select("a", "b", F.lit(1.0).alias("likeness")).distinct()
    width = 2 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("fingerprint", width * i + 1, F.lit(width))))
    # One document may be the least of several fingerprints, so members are fingerprints, and their keys are looked up.
    members = one.select(F.explode(band).alias("bucket"), F.col("fingerprint").alias("key"), F.lit(0).cast("long").alias("mark"), F.unhex("fingerprint").alias("sig"))
    found = links_in_buckets(members, least, forest=True)
    ends = found.join(one.select(F.col("fingerprint").alias("a"), F.col("key").alias("ka")), "a").join(one.select(F.col("fingerprint").alias("b"), F.col("key").alias("kb")), "b")
    near = ends.where("ka <> kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "likeness")
    return equal.unionByName(near)


def place_among(ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bounds (rows of id, hash, in order) lie below each (id, hash), and whether it is itself a bound."""
    first, after = (np.searchsorted(bounds[:, 0], ids, side) for side in ("left", "right"))
    at = first.copy()
    for i in np.unique(ids[after > first]):  # ids that bound a range
        some = ids == i
        a, b = np.searchsorted(bounds[:, 0], [i, i], "left")[0], np.searchsorted(bounds[:, 0], i, "right")
        at[some] = a + np.searchsorted(bounds[a:b, 1], hashes[some])
    at = np.minimum(at, len(bounds) - 1)
    return at, (bounds[at, 0] == ids) & (bounds[at, 1] == hashes)


def _greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greatest (i, h) of a partition."""
    best = max(((int(i[k]), int(h[k])) for i, h in ((b.column("i").to_numpy(), b.column("h").to_numpy()) for b in batches) if len(i) for k in [np.lexsort((h, i))[-1]]), default=None)
    if best:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in best], names=["i", "h"])


def range_size(total: int) -> int:
    """Bytes of a range where there are total bytes: ranges grow with their number until they are as large as a task should be."""
    return max(1, min(RANGE_MOST, math.isqrt(total * RANGE_UNIT)))


def by_descending_id(docs: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """doc_id, text, __range, __ahead: ranges of ids, each in one task in descending order, followed by the document that
    comes next after its last (__ahead = 1), which is the first of the range below; below the lowest, the first of all.

    Range bounds are rows that occur, the greatest of each part that Spark's range partitioning makes of (id, hash) alone, so
    the first of each range is known and travels to the range above as well: one shuffle of texts. A row takes part in that
    partitioning once, and once more for every ROW_BYTES of its text, so ranges are alike in bytes wherever the long texts are;
    texts are read for their sizes once. A range has range_bytes, or range_size() of the whole table, and the bounds are two numbers
    for each range. Rows of one id are in order of their text's hash, and a bound may lie among them; rows without an id come
    after all ids.
    """
    spark = docs.sparkSession
    hashed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LEAST)).alias("i"), F.xxhash64("text").alias("h"))
    places = materialize(hashed.select("i", "h", (1 + F.coalesce(F.octet_length("text"), F.lit(0)) / ROW_BYTES).cast("int").alias("weight")), "places")
    total = ROW_BYTES * (places.agg(F.sum("weight").alias("n")).first()["n"] or 0)
    n = -(-total // (range_bytes or range_size(total))) or 1
    if range_bytes is None:
        n = max(2 * spark.sparkContext.defaultParallelism, n)
    weighted = places.select("i", "h", F.explode(F.array_repeat(F.lit(0), "weight"))).select("i", "h")
    found = weighted.repartitionByRange(n, "i", "h").mapInArrow(_greatest, "i long, h long").toArrow()
    bounds = np.unique(np.stack([found.column(c).to_numpy().astype(np.int64) for c in ("i", "h")], axis=1), axis=0)
    if not len(bounds):
        bounds = np.zeros((1, 2), np.int64)
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf(T.IntegerType())
    def range_of(i: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(place_among(i.to_numpy(), h.to_numpy(), shared.value)[0], pa.int32())

    @F.arrow_udf(T.IntegerType())
    def range_above(i: pa.Array, h: pa.Array) -> pa.Array:
        """Of a row that bounds a range: the range above, or the lowest one for the greatest row. Of others -1."""
        at, is_bound = place_among(i.to_numpy(), h.to_numpy(), shared.value)
        return pa.array(np.where(is_bound, (at + 1) % len(shared.value), -1), pa.int32())

    both = hashed.select("doc_id", "text", "i", "h", range_of("i", "h").alias("own"), range_above("i", "h").alias("above"))
    at_home = F.struct(F.col("own").alias("r"), F.lit(0).alias("a"))
    homes = F.when(F.col("above") < 0, F.array(at_home)).otherwise(F.array(at_home, F.struct(F.col("above").alias("r"), F.lit(1).alias("a"))))
    placed = both.select("doc_id", "text", "i", "h", F.explode(homes).alias("p")).select("doc_id", "text", "i", "h", F.col("p.r").alias("__range"), F.col("p.a").alias("__ahead"))
    order = ["__range", "__ahead", F.desc("i"), F.desc("h"), F.asc_nulls_first("text")]
    return placed.repartitionById(len(bounds), F.col("__range")).sortWithinPartitions(*order).drop("i", "h")


FIELDS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
        T.StructField("bands_edited", T.LongType()), T.StructField("bands_next", T.LongType()),
    ]
)


def edited_text(text: str, after: str) -> str:
    """text with its last third replaced by the start of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _compared(rows: list[tuple[int | None, str]], after: list[str]) -> pa.RecordBatch:
    """Of each row and the text after it."""
    texts = [t for _, t in rows]
    edited = [edited_text(t, x) for t, x in zip(texts, after, strict=True)]
    every = list(dict.fromkeys([*texts, *after, *edited]))
    at = {t: i for i, t in enumerate(every)}
    prints = fingerprints(every)
    own, changed, other = (prints[[at[t] for t in some]] for some in (texts, edited, after))
    columns = [
        [d for d, _ in rows], [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in changed], likeness(own, changed), likeness(own, other), shared_bands(own, changed), shared_bands(own, other),
    ]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=FIELDS.names)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges in order; a row waits until the text after it has come."""
    ready: list[tuple[int | None, str]] = []
    after: list[str] = []
    last, first, now, held, closed = None, "", None, 0, True
    for batch in batches:
        for d, text, r, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__range", "__ahead")), strict=True):
            text = text or ""
            if r != now:
                if last is not None:  # a range that nothing follows: ids are missing
                    ready.append(last)
                    after.append(first)
                last, first, now, closed = None, text, r, False
            if last is not None:
                ready.append(last)
                after.append(text)
                held += len(last[1])
            last = None if ahead or closed else (d, text)
            closed = closed or bool(ahead)
            if held >= ABREAST:
                yield _compared(ready, after)
                ready, after, held = [], [], 0
    if last is not None:
        ready.append(last)
        after.append(first)
    if ready:
        yield _compared(ready, after)


def compare_edited(docs: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """FIELDS for every row of docs (doc_id, text): fingerprints of each text and of its edited text, and likenesses.

    The edited text ends in the start of the next document, by descending doc_id; after the last comes the first. Null texts
    are empty; two empty texts have likeness 1. Rows of one id are in order of their text's hash, and rows without an id come
    last. A single row is followed by itself. A very long text walks alone, which takes
    its task two seconds for 100,000 characters. An empty table gives an empty table. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    return by_descending_id(docs.select("doc_id", "text"), range_bytes).mapInArrow(_walked, FIELDS)


def op8_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of all documents."""
    return compare_edited(read(spark, sf_dir, "documents"))
