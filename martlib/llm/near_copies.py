"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of LEAST or more, for the pipeline.

Candidates come from two sides. The SimHash operator's grid (segment popcounts, Manhattan distance, exact check) links texts
whose fingerprints of five-word shingles differ in two bits or fewer. At a similarity of 0.8 about ten of 64 bits differ,
give or take three, and a radius that wide admits unrelated texts with the square of the corpus; so minima of ROWS shared
hashes form a band, and texts that agree on one of BANDS bands are candidates as well: at 0.8 all but one pair in 14,000.

Every candidate is verified on whole shingle sets, and no pair of sets is ever a row. First the texts that a star's head
brings together are held against the head, one after another. Then, in each bucket of a band whose members are still in
different groups, every two members of different groups meet in some cell of bounded size and are compared there; a cell
gives links enough to connect what is alike, one for each two groups that it joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.common import batches_of, map_texts, materialize
from martlib.llm.components import connected_components
from martlib.llm.simhash import majority, neighbour_links, shingle_hashes, words_of

SHINGLE, LEAST, SEED = 5, 0.8, 7
#: LOOSE: two texts are not compared in a cell if fewer of their minima agree (at 0.8: one pair in 40,000).
BANDS, ROWS, LOOSE = 24, 5, 0.65
#: Hashes that meet all hash functions at a time, so that a long text needs bounded memory.
BLOCK = 2048
#: Members of a part of a star or of half a cell, and bytes of the sets of half a cell; rows of an Arrow batch of sets.
MEMBERS, CELL_BYTES, SET_ROWS = 512, 8_000_000, 64
#: Hashes of sets that are compared in one step.
AT_ONCE = 2_000_000


def _tables():
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


FACTORS, SHIFTS = _tables()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def words_digest(text: str | None) -> int:
    """Of the words in ASCII lower case; 0 for a text without words."""
    words = words_of(text)
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)) if words else 0


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles, sorted, each once; fewer words: the whole sequence."""
    return np.unique(shingle_hashes(words_of(text), SHINGLE))


def similarities(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of a sorted set to each of others; none of them is empty."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    at[at == len(own)] = 0
    common = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return common / (len(own) + sizes - common)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hash functions over a set that is not empty."""
    out = np.full(len(FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), BLOCK):
            np.minimum(out, (hashes[None, at : at + BLOCK] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1), out=out)
    return out


def _sketches(texts: list) -> list[list]:
    digests, prints, bands, sigs = [], [], [], []
    for text in texts:
        digests.append(words_digest(text))
        hashes = shingle_hashes(words_of(text), SHINGLE)
        prints.append(majority(hashes))
        least = minima(np.unique(hashes)) if len(hashes) else None
        bands.append(None if least is None else [_signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, ROWS))])
        sigs.append(None if least is None else (least >> np.uint64(32)).astype(np.uint8).tobytes())
    return [digests, prints, bands, sigs]


def _sets_of(texts: list) -> list[list]:
    sets = [shingle_set(t) for t in texts]
    return [[words_digest(t) for t in texts], [len(s) for s in sets], [s.tobytes() for s in sets]]


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _links_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (a, part): the head's own row first, then its members; those that are like the head."""
    now, own = None, None
    for batch in batches:
        found = []
        for a, part, b, member, s in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "words", "member", "shingles")), strict=True):
            if (a, part) != now:
                now, own = (a, part), None
            other = np.frombuffer(s, "<u8")
            if not member:
                own = other
            elif own is not None and min(len(own), len(other)) >= LEAST * max(len(own), len(other)) and similarities(own, [other])[0] >= LEAST:
                found.append((a, b))
        if found:
            yield _links_of(found)


def _stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies. A head a with many members has them dealt to parts, each with the head's set."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("words"), F.lit(1).alias("member"))
    heads = parts.select("a", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("a").alias("words"), F.lit(0).alias("member"))
    rows = members.unionByName(heads).join(sets, "words").select("a", "part", "words", "member", "shingles")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "member").mapInArrow(_star_links, _LINKS)


def cell_links(keys: list[int], marks: np.ndarray, bands: np.ndarray, band: int, sigs: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the members of a cell as all links between members of different marks would.

    Two members are compared if the band is the first on which they agree (else another cell does), if their sizes allow it,
    and if LOOSE of their minima agree.
    """
    marks, found = marks.copy(), []
    sizes = np.array([len(s) for s in sets])
    for i in range(len(keys) - 1):
        rest = i + 1 + np.flatnonzero(marks[i + 1 :] != marks[i])
        if not len(rest):
            continue
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= LEAST * np.maximum(sizes[rest], sizes[i])]
        rest = rest[(sigs[rest] == sigs[i]).mean(axis=1) >= LOOSE] if len(rest) else rest
        rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == band] if len(rest) else rest
        at = 0
        while at < len(rest):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[rest[at:]]), AT_ONCE)) + at)
            some = rest[at:stop]
            for j in some[similarities(sets[i], [sets[k] for k in some]) >= LEAST]:
                if marks[j] != marks[i]:
                    found.append((keys[i], keys[j]))
                    marks[marks == marks[j]] = marks[i]
            at = stop
    return found


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell; the rows of one cell are held until the next begins."""

    def links(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(held)
        if rows.num_rows < 2:
            return []
        sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        bands = np.array(rows.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(s, "<u8") for s in rows.column("shingles").to_pylist()]
        return cell_links(rows.column("words").to_pylist(), rows.column("mark").to_numpy(), bands, rows.column("band")[0].as_py(), sigs, sets)

    held, now = [], None
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if held and cell[start] != now:
                if found := links(held):
                    yield _links_of(found)
                held = []
            now = cell[start]
            held.append(batch.slice(start, end - start))
    if held and (found := links(held)):
        yield _links_of(found)


def _between_groups(marked: DataFrame, one: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a bucket that are in different groups. marked: band, bucket, words, mark."""
    open_ = marked.groupBy("bucket").agg((F.min("mark") < F.max("mark")).alias("open"), F.count("*").alias("n")).where("open and n > 2").select("bucket")
    members = marked.join(open_, "bucket", "left_semi").join(sets.select("words", "size"), "words")
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum(8 * F.col("size")) / CELL_BYTES))
    sizes = members.groupBy("bucket").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("words"), F.col("blocks")).alias("own")
    met = members.join(sizes, "bucket").select("band", "bucket", "words", "mark", own, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    cells = met.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "band", "words", "mark")
    wide = cells.join(one.select("words", "bands", "sig"), "words").join(sets.select("words", "shingles"), "words")
    rows = wide.select("cell", "band", "words", "mark", "bands", "sig", "shingles")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links, _LINKS)


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: key, print (xxhash64 of the text) and words (digest of its words) for each row of docs. groups:
    (words, key, root): for each digest of words, the least key that has it, and a number that its group of near copies shares.

    A group is what links of similarity LEAST or more connect. Texts without words are one group. Keys are not null. An empty
    table gives empty tables.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text"))
    added = [T.StructField("words", T.LongType()), T.StructField("simhash", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    rows = materialize(map_texts(slim, "text", added, lambda: _sketches, drop=("text",)), "sketches")
    n = rows.count()  # what follows has so many texts at most: tables have files by their rows, not by tasks
    keep = lambda df, label, times=1, wide=True: materialize(df, label, n * times, wide)
    one = keep(rows.groupBy("words").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("simhash", "bands", "sig")]), "texts")

    # Stars of the grid: equal fingerprints around the least digest, and linked fingerprints by their least digests.
    prints = keep(one.where("bands IS NOT NULL").groupBy(F.col("simhash").alias("fp")).agg(F.min("words").alias("least")), "prints")
    equal = one.where("bands IS NOT NULL").join(prints, F.col("simhash") == F.col("fp")).where("words <> least").select(F.col("least").alias("a"), F.col("words").alias("b"))
    of = lambda side: prints.select(F.col("fp").alias(f"f{side}"), F.col("least").alias(side))
    linked = neighbour_links(prints.select("fp")).select(F.col("b").alias("fa"), F.col("a").alias("fb"))
    grid = equal.unionByName(linked.join(of("a"), "fa").join(of("b"), "fb").select("a", "b"))

    placed = one.select("words", F.posexplode("bands").alias("band", "bucket"))
    met = placed.groupBy("bucket").agg(F.min("words").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    shared = keep(placed.join(keep(met, "met"), "bucket"), "shared", BANDS)
    pairs = keep(grid.unionByName(shared.where("words <> head").select(F.col("head").alias("a"), F.col("words").alias("b"))).distinct(), "pairs", BANDS)

    involved = pairs.select(F.explode(F.array("a", "b")).alias("words")).union(shared.select("words")).distinct()
    of_key = slim.select("key", "text").join(one.join(involved, "words", "left_semi").select("key").distinct(), "key", "left_semi")
    fields = [T.StructField("words", T.LongType()), T.StructField("size", T.LongType()), T.StructField("shingles", T.BinaryType())]
    sets = map_texts(of_key.select("text"), "text", fields, lambda: _sets_of, drop=("text",)).where("size > 0")
    sets = keep(sets.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")), "sets")

    with batches_of(spark, SET_ROWS):
        roots = keep(connected_components(keep(_stars(pairs, sets), "links", BANDS)), "roots", wide=False)
        marked = shared.join(roots.withColumnRenamed("node", "words"), "words", "left").select("band", "bucket", "words", F.coalesce("root", "words").alias("mark"))
        more = keep(_between_groups(keep(marked, "marked", BANDS), one, sets), "links", BANDS)
    both = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = connected_components(both)
    groups = one.select("words", "key").join(roots.withColumnRenamed("node", "words"), "words", "left").select("words", "key", F.coalesce("root", "words").alias("root"))
    return rows.select("key", "print", "words"), groups


def group_heads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print, n): of each group the least key, the print of its text (the least digest of words and then the least print, if
    one key has several texts of the group), and how many rows have both."""
    rows, groups = near_copy_groups(docs, key, text)
    least = groups.groupBy("root").agg(F.min(F.struct("key", "words")).alias("head")).select("head.*")
    own = rows.join(least, ["key", "words"]).groupBy("key", "words", "print").agg(F.count("*").alias("n"))
    return own.groupBy("key", "words").agg(F.min(F.struct("print", "n")).alias("p")).select("key", "p.print", "p.n")
