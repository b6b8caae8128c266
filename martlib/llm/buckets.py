"""Comparing the members of buckets with each other, in groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from martlib.llm.common import small_batches

#: Members of a block; a larger bucket is cut into blocks, and each two blocks meet in one group.
BLOCK = 512
_YIELD = 10_000


def _forest(sigs: np.ndarray, marks: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, likeness): links that connect whatever all links of likeness least or more connect."""
    left = np.arange(len(sigs))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            like = (sigs[left] == sigs[i]).mean(axis=1)
            hit = like >= least
            yield i, left[hit], like[hit]
            queue.extend(left[hit])
            left = left[~hit]


def _across(sigs: np.ndarray, marks: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, likeness): all links of likeness least or more between different marks."""
    for i in range(len(sigs) - 1):
        rest = i + 1 + np.flatnonzero(marks[i + 1 :] != marks[i])
        like = (sigs[rest] == sigs[i]).mean(axis=1)
        hit = like >= least
        yield i, rest[hit], like[hit]


def links_in_buckets(members: DataFrame, least: float, forest: bool, block: int = BLOCK) -> DataFrame:
    """(a, b, likeness), a before b: links between members of one bucket, likeness being the share of equal bytes of sig.

    members: bucket (long), key, mark (long), sig (binary, of one length), without nulls, a key once in a bucket. forest: the
    links connect the same members as all links of likeness least or more would, and a group of like members costs one
    comparison each. Otherwise all such links between members of different marks. Every two members of a bucket meet in some
    group; a group has 2 * block members or so at most, whatever the size of its bucket.
    """
    small_batches(members.sparkSession)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).alias("own")
    met = members.join(sizes, "bucket").select("bucket", "key", "mark", "sig", own, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    cells = met.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "key", "mark", "sig")
    kind = members.schema["key"].dataType
    types = [to_arrow_type(kind), to_arrow_type(kind), pa.float64()]
    find = _forest if forest else _across

    def links(held: list[pa.RecordBatch]) -> Iterator[tuple]:
        rows = pa.Table.from_batches(held)
        if rows.num_rows < 2:
            return
        keys, marks = rows.column("key").to_pylist(), rows.column("mark").to_numpy()
        sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(keys), -1)
        for i, others, like in find(sigs, marks, least):
            for j, x in zip(others.tolist(), like.tolist(), strict=True):
                yield (*sorted((keys[i], keys[j])), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=["a", "b", "likeness"])
        held, now = [], None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if held and cell[start] != now:
                    for link in links(held):
                        made.append(link)
                        if len(made) == _YIELD:
                            yield batch_of()
                            made.clear()
                    held = []
                now = cell[start]
                held.append(batch.slice(start, end - start))
        for link in links(held) if held else ():
            made.append(link)
            if len(made) == _YIELD:
                yield batch_of()
                made.clear()
        if made:
            yield batch_of()

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("likeness", T.DoubleType())])
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema).distinct()
