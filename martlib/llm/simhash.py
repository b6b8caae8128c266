"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into SEGMENTS segments, and the numbers of bits set in each form a point on an integer grid. The
Manhattan distance of two points is a lower bound of the Hamming distance of the fingerprints, so fingerprints within two
bits lie within distance two on the grid, and then some grid point is within one of both. Each fingerprint therefore
registers at its own cell and at the cells one step away; those that meet no other one in any cell have no neighbours.

Verification is exact and free of pairs: two fingerprints differ in two bits or fewer if and only if some 64-bit value is
within one bit of both. In each cell that it shares, a fingerprint lists the values of that cell within one bit of itself
(65 over all cells), and fingerprints with a value in common are linked to the least of them. A value has 65 such
neighbours at most, whatever the corpus, so no group grows with its size. Exact copies share a fingerprint and count once.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.common import map_texts, materialize, read
from martlib.llm.components import connected_components

SHINGLE, SEED, SEGMENTS, BITS = 3, 42, 32, 64
#: Bits of a segment, and bits that hold its count.
WIDTH = FIELD = BITS // SEGMENTS
#: Hashes whose bits are counted at a time, so that a long text needs bounded memory.
BLOCK = 16_384


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in ASCII lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; fewer words: of the whole sequence; none: nothing."""
    if len(words) <= shingle:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in runs), "<u8")


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that over half of the hashes have, as a signed 64-bit number; 0 for none."""
    sums = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        sums += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(words_of(text), shingle))


def add_fingerprint(df: DataFrame, text: str = "text", drop: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """Append simhash (long) of shingles of so many words. Null and empty texts, and texts without words, have 0."""
    return map_texts(df, text, [T.StructField("simhash", T.LongType())], lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], drop)


def _point(fp: Column) -> Column:
    """The grid point as one number: FIELD bits for each segment's count."""
    mask, total = (1 << WIDTH) - 1, F.lit(0).cast("long")
    for k in range(SEGMENTS):
        bits = F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit(mask))
        total = total.bitwiseOR(F.shiftleft(F.bit_count(bits).cast("long"), FIELD * k))
    return total


def grid_cells(fps: DataFrame) -> DataFrame:
    """(fp, k, d, cell): each fingerprint's own cell (k = -1) and those one step up or down (d) in segment k."""
    grid = fps.select("fp", _point(F.col("fp")).alias("point"))
    steps = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("d")), *[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k in range(SEGMENTS) for d in (1, -1)])
    full = (1 << FIELD) - 1
    count = F.expr(f"shiftrightunsigned(point, {FIELD} * greatest(s.k, 0)) & {full}L")
    moved = F.expr(f"(point & ~shiftleft({full}L, {FIELD} * greatest(s.k, 0))) | shiftleft((shiftrightunsigned(point, {FIELD} * greatest(s.k, 0)) & {full}L) + s.d, {FIELD} * greatest(s.k, 0))")
    inside = (F.col("s.k") < 0) | ((F.col("s.d") == 1) & (count < WIDTH)) | ((F.col("s.d") == -1) & (count > 0))
    return grid.select("fp", "point", F.explode(steps).alias("s")).where(inside).select("fp", "s.k", "s.d", moved.alias("cell"))


def neighbour_links(fps: DataFrame) -> DataFrame:
    """(a, b) links between fingerprints (column fp, distinct) such that fingerprints within two bits are connected through
    fingerprints within two bits, and no others are."""
    cells = grid_cells(fps)
    # Written first, so that its size is known: while few cells are shared, the join below needs no shuffle.
    met = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "cells")
    shared = cells.join(met, "cell", "left_semi")
    # The values of the cell within one bit: fp itself, or fp with one 0 (d = 1) or 1 (d = -1) of segment k turned over.
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: WIDTH * F.col("k") + i), lambda p: F.getbit("fp", p) == F.when(F.col("d") == 1, 0).otherwise(1))
    values = F.when(F.col("k") < 0, F.array("fp")).otherwise(F.transform(bits, lambda p: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int")))))
    near = shared.select("fp", F.explode(values).alias("value"))
    groups = near.groupBy("value").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)  # 65 at most
    return groups.select(F.explode(F.slice("fps", 2, BITS + 1)).alias("a"), F.get("fps", F.lit(0)).alias("b")).distinct()


def near_groups(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, simhash, component_id): the least key that a row reaches over links of two or fewer differing bits.

    A null key has a fingerprint and links as any other, but is no component_id unless its whole group has none. Repeated
    rows each give a row. Texts without words all have fingerprint 0 and link to each other. Empty in, empty out.
    """
    prints = materialize(prints.select(F.col(key).alias("key"), "simhash"), "prints")
    fps = materialize(prints.groupBy(F.col("simhash").alias("fp")).agg(F.min("key").alias("least")), "fps")
    roots = connected_components(neighbour_links(fps))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(of_root, "root").select(F.col("fp").alias("simhash"), "component_id")
    return prints.join(classes, "simhash").select(F.col("key").alias(key), "simhash", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_groups(add_fingerprint(docs, drop=("text",)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints need XXH64, which DuckDB lacks: tested against brute force instead.
ORACLE_SQL = None
