"""Centroid clustering with a VA-file: vectors as a few bits per component, distance intervals from lookup tables.

Components are integers, so every sum and distance is exact. Each component's range is cut into 2**BITS cells, and a vector's
cells are its approximation. For a set of centroids, a table gives the least and greatest contribution of each cell of each
component to the squared distance from each centroid; the sums over a vector's cells enclose its distance from every centroid.
Distances are taken less the vector's squared distance from the middle of all centroids: that term is the same for all
centroids, so their order stays, but it makes up most of an interval's width. A centroid is a candidate if its interval begins
no later than the earliest end of all. Vectors with one candidate are assigned by their cells alone; for the others the full
vector is fetched, and compared with its candidates only.

Centroids move by differences: a vector that changes its cluster is taken from the one sum and added to the other, so a
vector that stays is not fetched for the mean either. Only the first round and the final distances read all full vectors.

In Spark: full vectors, and the cells with their last assignment, are tables bucketed by one row number. Fetching is a join of
buckets that lie side by side, without a shuffle; what is shuffled in a round is a sum for each task and cluster. The driver
holds centroids, cell bounds and sums: numbers that depend on k and the length of a vector, not on how many vectors there are.
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

from martlib.llm.common import batches_of, bucketed, materialize, read

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Bits of a cell, which is stored as a byte.
BITS = 6
CELLS = 1 << BITS
#: The size of scaled components stays under LARGEST divided by the square root of their number, and distances within a long.
LARGEST = 1 << 29
#: Vectors of a bucket, and rows of an Arrow batch of vectors.
BUCKET_ROWS, VECTOR_ROWS = 250_000, 4096
#: Standard deviations from the mean that the inner cells cover.
SPREAD = 2.5

_ROW = T.StructField("row", T.LongType())
_DELTA = T.ArrayType(T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]))


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def whole_vectors(df: DataFrame, key: str, vector: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(row, id, ints) of the vectors with so many components, none null or non-finite: floor(scale * x) as 32-bit integers.

    row numbers the rows. A component so large that distances could leave the range of a long is an error.
    """
    largest = LARGEST / math.sqrt(components)
    v = F.col(vector).cast("array<double>")
    whole = df.where((F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    slim = whole.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), v.alias("v"))
    schema = T.StructType([_ROW, T.StructField("id", df.schema[key].dataType), T.StructField("ints", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.floor(scale * b.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, components)
                if np.abs(x).max() >= largest:
                    raise ValueError(f"a component is {np.abs(x).max()} after scaling; {largest} is too large")
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), _binaries(x.astype("<i4"))], names=["row", "id", "ints"])

    return slim.mapInArrow(run, schema)


def _spans(full: DataFrame, components: int) -> np.ndarray:
    """count, sum, sum of squares, least and greatest of each component, over all vectors: one row for each task and component
    is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _matrix(b.column("ints"), "<i4", components).astype(np.float64)
            if len(x):
                now = np.stack([np.full(components, float(len(x))), x.sum(0), (x * x).sum(0), -x.min(0), x.max(0)])
                total = now if total is None else np.concatenate([total[:3] + now[:3], np.maximum(total[3:], now[3:])])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(components, dtype=np.int32)), *map(pa.array, total)], names=["d", "n", "s", "q", "low", "high"])

    made = full.select("ints").mapInArrow(run, "d int, n double, s double, q double, low double, high double")
    rows = made.groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.max("low"), F.max("high")).orderBy("d").collect()  # a row for each component
    n, s, q, low, high = np.array([tuple(r)[1:] for r in rows]).T
    return np.stack([s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)), -low, high])


def cell_bounds(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), components x CELLS: the integers that each cell holds, ends included. spans: mean, deviation, least and
    greatest. Cells are of equal width around the mean; the outer ones reach to the least and the greatest."""
    mean, deviation, least, greatest = spans
    left, right = np.maximum(least, mean - SPREAD * deviation), np.minimum(greatest + 1, mean + SPREAD * deviation)
    low = np.ceil(left[:, None] + (right - left)[:, None] * np.arange(CELLS) / CELLS).astype(np.int64)
    low[:, 0] = least
    low = np.maximum.accumulate(low, axis=1)
    high = np.concatenate([low[:, 1:] - 1, greatest[:, None].astype(np.int64)], axis=1)
    return low, np.maximum(high, low)


def cells_of(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The cell of each component, a byte each."""
    return np.stack([np.searchsorted(edges, x[:, d], side="right") - 1 for d, edges in enumerate(low)], axis=1).astype(np.uint8)


class Intervals:
    """For given centroids: the table of contributions by component and cell, and what it says of vectors."""

    def __init__(self, low: np.ndarray, high: np.ndarray, centroids: np.ndarray):
        # (x - c)^2 = (x - o)^2 - 2 (x - o) (c - o) + (c - o)^2, and the first term does not depend on c.
        middle = np.rint(centroids.mean(axis=0)).astype(np.int64)
        off = (centroids - middle).T[:, None, :]  # components x 1 x k
        one, other = (-2 * (edge - middle[:, None])[:, :, None] * off for edge in (low, high))
        self.k, self.table = len(centroids), np.concatenate([np.minimum(one, other), np.maximum(one, other)], axis=2) + np.tile(off * off, 2)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """vectors x k: whether the centroid may be the nearest one. The nearest is among them, and so are its ties."""
        total = np.zeros((len(cells), 2 * self.k), np.int64)
        for d, table in enumerate(self.table):
            total += table[cells[:, d]]
        return total[:, : self.k] <= total[:, self.k :].min(axis=1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest candidate; ties go to the smaller number."""
    away = np.full(candidates.shape, np.iinfo(np.int64).max)
    for k in np.flatnonzero(candidates.any(axis=0)):
        some = candidates[:, k]
        away[some, k] = ((x[some] - centroids[k]) ** 2).sum(axis=1)
    best = away.argmin(axis=1)
    return best, away[np.arange(len(x)), best]


def _bounded(state: DataFrame, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """state (row, cells, was) with the cluster that the cells decide (now), or else the candidates as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(low, high, centroids)
        for b in batches:
            if not b.num_rows:
                continue
            may = intervals.candidates(_matrix(b.column("cells"), np.uint8, len(intervals.table)))
            one = may.sum(axis=1) == 1
            now = pa.array(may.argmax(axis=1).astype(np.int32), mask=~one)
            open_ = pa.array([None if alone else np.flatnonzero(m).astype("<u2").tobytes() for alone, m in zip(one, may, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("cells"), b.column("was"), now, open_], names=["row", "cells", "was", "now", "open"])

    return state.mapInArrow(run, "row long, cells binary, was int, now int, open binary")


def _candidate_rows(b: pa.RecordBatch, k: int) -> np.ndarray:
    may = np.zeros((b.num_rows, k), bool)
    for i, (now, some) in enumerate(zip(b.column("now").to_pylist(), b.column("open").to_pylist(), strict=True)):
        may[i, now if some is None else np.frombuffer(some, "<u2")] = True
    return may


def _moved(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(row, now, deltas) of fetched (row, was, now, open, ints). The last row of a task carries what its vectors add to and take
    from each cluster."""
    k, components = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, last = np.zeros((k, components), np.int64), np.zeros(k, np.int64), None
        schema = pa.schema([("row", pa.int64()), ("now", pa.int32()), ("deltas", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))])
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("ints"), "<i4", components).astype(np.int64)
            now, _ = nearest(x, centroids, _candidate_rows(b, k))
            was = b.column("was").fill_null(-1).to_numpy()
            for c in range(k):
                come, gone = (now == c) & (was != c), (was == c) & (now != c)
                sums[c] += x[come].sum(axis=0) - x[gone].sum(axis=0)
                counts[c] += int(come.sum()) - int(gone.sum())
            made = pa.RecordBatch.from_arrays([b.column("row"), pa.array(now.astype(np.int32)), pa.nulls(b.num_rows, schema.field("deltas").type)], schema=schema)
            if last is not None:
                yield last
            last = made
        if last is not None:
            yield last.slice(0, last.num_rows - 1)
            end = last.slice(last.num_rows - 1)
            deltas = [{"cluster": c, "n": int(counts[c]), "sums": sums[c].tolist()} for c in range(k) if counts[c] or sums[c].any()]
            yield pa.RecordBatch.from_arrays([end.column("row"), end.column("now"), pa.array([deltas], schema.field("deltas").type)], schema=schema)

    return fetched.mapInArrow(run, T.StructType([_ROW, T.StructField("now", T.IntegerType()), T.StructField("deltas", _DELTA)]))


def _add_deltas(moved: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Add what a round moved to the sums and counts of clusters, which are Python's integers. k times components rows."""
    deltas = moved.where("deltas IS NOT NULL").select(F.explode("deltas").alias("d")).select("d.*")
    for r in deltas.groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        counts[r["cluster"]] += r["n"]
    each = deltas.select("cluster", F.posexplode("sums").alias("at", "x"))
    for r in each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        sums[r["cluster"]][r["at"]] += int(r["x"])


def first_centroids(full: DataFrame, n: int, k: int, seed: int, components: int) -> np.ndarray:
    """The k vectors of smallest sha256 of '<seed>:<id>' (equal ids: of smallest components; a null id counts as '').

    Only hashes under a bound that lets about 5 * k through are sorted, k for each task at most; the bound rises if fewer than
    k do come through."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    share = 5 * k / max(n, 1)
    while True:
        some = full.select(order.alias("h"), "ints")
        if share < 1:
            some = some.where(F.col("h") < format(int(share * (1 << 32)), "08x"))
        found = some.orderBy("h", "ints").limit(k).collect()  # k rows
        if len(found) == k or share >= 1:
            return np.array([np.frombuffer(r["ints"], "<i4") for r in found], np.int64).reshape(-1, components)
        share *= 8


def _cells_table(full: DataFrame, low: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = cells_of(_matrix(b.column("ints"), "<i4", len(low)), low)
                yield pa.RecordBatch.from_arrays([b.column("row"), _binaries(codes), pa.nulls(b.num_rows, pa.int32())], names=["row", "cells", "was"])

    return full.select("row", "ints").mapInArrow(run, "row long, cells binary, was int")


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, bucket_rows: int = BUCKET_ROWS
) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance), centroids): Lloyd's rounds from the vectors of smallest hash, then a last assignment.

    Vectors of another length, with a null or a non-finite component, and null vectors are left out. Repeated rows, rows of
    one id and rows without one each give a row. Fewer vectors than k: that many clusters. None: an empty table and no
    centroids. Empty clusters keep their centroid. Further columns are ignored. k is 65,535 at most.
    """
    spark = df.sparkSession
    with batches_of(spark, VECTOR_ROWS):
        source = whole_vectors(df.select(key, vector), key, vector, components, scale)
        plain = materialize(source, "vectors")
        n = plain.count()
        if not n:
            return plain.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, components), np.int64)
        buckets = max(spark.sparkContext.defaultParallelism, -(-n // bucket_rows))
        full = bucketed(plain.repartition(buckets, "row"), "full", "row", buckets)
        low, high = cell_bounds(_spans(full, components))
        state = bucketed(_cells_table(full, low), "cells", "row", buckets)
        now = first_centroids(full, n, k, seed, components)
        sums, counts = [[0] * components for _ in now], [0] * len(now)
        for _ in range(rounds):
            known = bucketed(_bounded(state, low, high, now), "bounded", "row", buckets)
            open_ = known.where("now IS NULL OR was IS NULL OR now <> was").drop("cells")
            moved = bucketed(_moved(open_.hint("merge").join(full.select("row", "ints"), "row"), now), "moved", "row", buckets)
            _add_deltas(moved, sums, counts)
            now = np.array([[s // counts[c] for s in sums[c]] if counts[c] else now[c].tolist() for c in range(len(now))], np.int64)
            fetched = moved.select("row", F.col("now").alias("then"))
            state = known.select("row", "cells", "now").hint("merge").join(fetched, "row", "left").select("row", "cells", F.coalesce("then", "now").alias("was"))
        known = bucketed(_bounded(state, low, high, now), "bounded", "row", buckets)
        last = known.select("row", "now", "open").hint("merge").join(full, "row").select("id", "now", "open", "ints")
        return materialize(_measured(last, now, df.schema[key].dataType), "clusters").withColumnRenamed("id", key), now


def _measured(last: DataFrame, centroids: np.ndarray, kind: T.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("ints"), "<i4", centroids.shape[1]).astype(np.int64)
                number, away = nearest(x, centroids, _candidate_rows(b, len(centroids)))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(number.astype(np.int32)), pa.array(away)], names=["id", "cluster", "distance"])

    return last.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every whole vector, with the sums of distances and a digest of its centroid."""
    found, centroids = cluster_vectors(read(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    rows = [(c, int(sums.get(c, 0)), int(sum(sums.values())), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (SELECT row, arg_min(k, (away, k)) AS k, min(away) AS away FROM
    (SELECT v.row, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS away FROM v JOIN c{r} c USING (d) GROUP BY ALL) GROUP BY row)"""


def _means_sql(r: int) -> str:
    return f"""
m{r} AS (SELECT a.k, v.d, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN a{r} a USING (row) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.k, c.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x)::BIGINT AS x FROM c{r} c LEFT JOIN m{r} m USING (k, d))"""


#: The same in DuckDB: all distances from all centroids in each round.
ORACLE_SQL = (
    f"""
WITH w AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS row FROM embeddings
           WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
v AS MATERIALIZED (SELECT row, unnest(range({COMPONENTS})) AS d, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM w),
c0 AS MATERIALIZED (SELECT row AS k, d, x FROM v WHERE row < {CENTROIDS}),"""
    + ",".join(_round_sql(r) + ("," + _means_sql(r) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    + f""",
s AS (SELECT k, sum(away)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY k),
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT w.vec_id, a.k::INTEGER AS cluster, a.away AS distance, s.cluster_inertia, (SELECT sum(away)::BIGINT FROM a{ROUNDS}) AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN w USING (row) JOIN s USING (k) JOIN h USING (k)
"""
)
