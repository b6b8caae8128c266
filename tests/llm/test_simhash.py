import random

import xxhash
from pyspark.sql import functions as F

from martlib.llm import simhash as S
from tests.llm.conftest import ROWS, tables


def plainly(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{position: least key} by all pairs."""
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i, (key, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(key)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(prints))]


def test_fingerprints_and_components(spark, odd, none, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    made = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(120)]
        made += [(1000 + 3 * i, " ".join(base)), (1001 + 3 * i, " ".join([*base[:-1], "Z"])), (1002 + 3 * i, "  ".join(base).upper())]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], odd.schema))
    got = S.op7_simhash(spark, tables(spark, tmp_path, documents=docs)).collect()
    prints = [(r[0], plainly(r[1])) for r in [*ROWS, *made]]
    want = sorted(zip([p[0] for p in prints], [f"{p[1]:016x}" for p in prints], components(prints), strict=True), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert S.op7_simhash(spark, tables(spark, tmp_path / "none", documents=none)).count() == 0


def test_links_equal_all_pairs(spark):
    rng = random.Random(3)
    fps = [0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1, 3, 1, *[rng.getrandbits(64) for _ in range(30)]]
    for b in fps[:25]:
        for _ in range(12):
            x = b
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, simhash long")
    got = {r["doc_id"]: r["component_id"] for r in S.near_groups(df).collect()}
    assert [got[i] for i in range(len(fps))] == components(list(enumerate(fps)))


def test_long_chains_and_stars(spark):
    chain = spark.range(1, 300).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    star = spark.range(1001, 1500).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    roots = {r["node"]: r["root"] for r in S.connected_components(chain.union(star)).collect()}
    assert len(roots) == 800 and all(v == (0 if k < 1000 else 1000) for k, v in roots.items())
