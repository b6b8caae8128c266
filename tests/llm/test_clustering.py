"""Clusters against plain integers, and what the cells decide."""

import hashlib
import math

import numpy as np
import pytest

from martlib.llm import clustering as C
from tests.conftest import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, k, rounds, seed):
    """(number by row, distance by row, centroids) of (id, components) rows, in Python's integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centres = [list(v) for _, v in order[:k]]

    def assign():
        away = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for _, v in kept]
        return [min(range(len(centres)), key=lambda c, d=d: (d[c], c)) for d in away], away

    for _ in range(rounds):
        got, _ = assign()
        for c in range(len(centres)):
            members = [v for (_, v), g in zip(kept, got, strict=True) if g == c]
            centres[c] = [sum(x) // len(members) for x in zip(*members, strict=True)] if members else centres[c]
    got, away = assign()
    return sorted(((i, g, d[g]) for (i, _), g, d in zip(kept, got, away, strict=True)), key=str), centres


def made(n, components, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, components))
    return [(i, (middles[i % 5] + 0.4 * rng.normal(size=components)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("components,k,rounds", [(8, 5, 3), (7, 12, 2), (1, 3, 4)])
def test_equals_plain_rounds(spark, components, k, rounds):
    vectors = made(150, components, components)
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], SCHEMA)
    got, centroids = C.cluster_vectors(df, components=components, k=k, rounds=rounds, bucket_rows=40)
    want, centres = plain(vectors, k, rounds, C.SEED)
    assert sorted(rows(got), key=str) == want
    assert centroids.tolist() == centres


def test_odd_rows(spark):
    """Short, long, null and non-finite vectors go; ties, repeats, equal vectors and rows without an id stay."""
    good = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.5, -0.5]), (None, [2.0, 2.0]), (None, [2.0, 2.5]), (7, [0.0, 0.0]), (8, [1e3, -1e3])]
    bad = [(10, None), (11, []), (12, [1.0]), (13, [1.0, 2.0, 3.0]), (14, [1.0, None]), (15, [1.0, float("nan")]), (16, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], SCHEMA).withColumnRenamed("label", "row")
    for k in (1, 3, 40):
        got, centroids = C.cluster_vectors(df, components=2, k=k)
        want, centres = plain(good, k, C.ROUNDS, C.SEED)
        assert sorted(rows(got), key=str) == want and centroids.tolist() == centres
    got, centroids = C.cluster_vectors(df.where("vec_id > 9"), components=2)
    assert got.columns == ["vec_id", "cluster", "distance"] and got.count() == 0 and len(centroids) == 0


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        C.cluster_vectors(spark.createDataFrame([(1, [3e38, 0.0], 0)], SCHEMA), components=2)


def test_intervals_hold_the_distance():
    """A vector's nearest centroid and its ties are always candidates, and cells alone decide most vectors of clear groups."""
    rng = np.random.default_rng(3)
    centroids = rng.integers(-300, 300, (20, 16))
    x = np.concatenate([centroids[rng.integers(0, 20, 3000)] + rng.integers(-60, 60, (3000, 16)), rng.integers(-5000, 5000, (200, 16)), centroids])
    f = x.astype(float)
    low, high = C.cell_bounds(np.stack([f.mean(0), f.std(0), f.min(0), f.max(0)]))
    cells = C.cells_of(x, low)
    at = np.arange(16)
    assert all((low[at, c] <= v).all() and (v <= high[at, c]).all() for v, c in zip(x, cells, strict=True))
    may = C.Intervals(low, high, centroids).candidates(cells)
    away = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert may[away == away.min(axis=1)[:, None]].all()
    assert (may[:3000].sum(axis=1) == 1).mean() > 0.5
    number, distance = C.nearest(x, centroids, may)
    assert (number == away.argmin(axis=1)).all() and (distance == away.min(axis=1)).all()


def test_rounds_shuffle_no_vectors(spark):
    """Full vectors and cells meet bucket by bucket."""
    a = C.bucketed(spark.range(100).selectExpr("id AS row", "id AS x"), "a", "row", 4)
    b = C.bucketed(spark.range(100).selectExpr("id AS row", "-id AS y"), "b", "row", 4)
    joined = a.hint("merge").join(b, "row")
    assert joined.where("x = -y").count() == 100
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
