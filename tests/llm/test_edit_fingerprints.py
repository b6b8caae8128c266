import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from martlib.llm import edit_fingerprints as E
from tests.llm.conftest import tables


def walked(text):
    """The sampled steps of the walks, one step at a time."""
    codes, best = [*map(int, E.classes(text)), 0], {}
    for w in range(E.WALKS):
        at, j = 0, 0
        while at < len(codes) - 1:
            bins, ranks = E._steps(w, j - j % E._BLOCK)
            b = w * E.OF_WALK + bins[j % E._BLOCK]
            best[b] = min(best.get(b, (1 << 65, 0)), (ranks[j % E._BLOCK], (codes[at] * 263 + codes[at + 1]) % 255 + 1))
            at += int(E.MOVES[w][j % E.PERIOD][codes[at]])
            j += 1
    if not best:
        return [0] * E.BINS
    return [next(best[k % E.BINS][1] for k in range(b, b + E.BINS) if k % E.BINS in best) for b in range(E.BINS)]


def test_walks_abreast_equal_walks_alone():
    rng = random.Random(2)
    texts = ["", "a", "ab", "x" * 500, "é\U0001f600" * 40, *["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 700))) for _ in range(25)]]
    got = E.fingerprints(texts)
    assert [list(map(int, g)) for g in got] == [walked(t) for t in texts]
    assert E.fingerprints([]).shape == (0, E.BINS)


def test_likeness_follows_edits():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    edit = lambda n: "".join("" if rng.random() < n / 2 else rng.choice("abc") if rng.random() < n / 2 else c for c in text)
    other = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    f = E.fingerprints([text, edit(0.002), edit(0.02), other])
    near = [E.likeness(f[:1], f[i : i + 1])[0] for i in (0, 1, 2, 3)]
    assert near[0] == 1 and near[0] >= near[1] > near[2] >= near[3] and near[3] < 0.2


def test_query_equals_a_plain_pass(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 7 - 50, "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 90)))) for i in range(60)] + [(3000, None), (3001, ""), (500, "same"), (501, "same")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, extra string").repartition(5)
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = E.fingerprints([t, edited, after])
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), (a == b).mean(), (a == c).mean())
    for size in (None, 100_000_000, 20_000):
        got = E.compare_edited(docs, size).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got} == want
    assert E.op8_edit_fingerprints(spark, tables(spark, tmp_path, documents=docs)).count() == len(rows)


def test_edge_cases(spark, odd, none):
    got = E.compare_edited(odd).collect()
    assert len(got) == odd.count()
    assert {r["fingerprint"] for r in got if r["doc_id"] in (6, 7)} == {E.fingerprints(["The cat sat on the mat.\nThe cat sat on the mat."])[0].tobytes().hex()}
    assert [r["fingerprint"] for r in got if r["doc_id"] == 1] == ["00" * E.BINS]
    assert E.compare_edited(none).count() == 0
    one = E.compare_edited(odd.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 3
    missing = spark.createDataFrame([(None, "a b c"), (None, "d")], "doc_id long, text string")
    assert E.compare_edited(missing).count() == 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_recall_against_exact_edit_distance(spark):
    """Texts of 400 characters with a few edits: pairs within two per cent of their length are found, others are not."""
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = "".join(rng.choice("abcdefghij ") for _ in range(400))
        for n in (0, 1, 2, 4):
            t = list(base)
            for _ in range(n):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice(["", [rng.choice("xyz")], [t[at], rng.choice("xyz")]])
            texts.append("".join(t))
    near = {(i, j) for f in range(0, 100, 4) for i in range(f, f + 4) for j in range(i + 1, f + 4) if edit_distance(texts[i], texts[j]) <= 8}
    links = E.similar_documents(E.add_fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    up = list(range(100))
    find = lambda i: i if up[i] == i else find(up[i])
    for r in links.collect():
        up[find(r["a"])] = find(r["b"])
        assert r["a"] // 4 == r["b"] // 4
    assert len(near) > 100 and sum(find(i) == find(j) for i, j in near) >= 0.9 * len(near)


def test_one_id_in_many_ranges(spark):
    """A third of the rows have one id, a third have none; every row is compared with the one after it."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    want = sorted((E.likeness(f[:1], f[1:])[0], len(t)) for k, (_, t) in enumerate(order) for f in [E.fingerprints([t, order[(k + 1) % 90][1]])])
    for size in (None, 20_000):
        assert sorted((r["near_next"], r["n_chars"]) for r in E.compare_edited(docs, size).collect()) == want


def test_similar_documents(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(600)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:-2] + "zz") for i, t in enumerate(base[:20])] + [(200, base[0]), (None, base[0])]
    links = E.similar_documents(E.add_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    pairs = {(r["a"], r["b"]) for r in links}
    assert sum((i, 100 + i) in pairs for i in range(20)) >= 18 and all(b in (a + 100, a + 200) for a, b in pairs)
    assert all(0.8 <= r["likeness"] <= 1 for r in links) and np.isfinite([r["likeness"] for r in links]).all()


def test_links_past_a_dissimilar_head(spark):
    """Each bucket that b and c share has a least key that is like neither; blocks of any size give the same links."""
    rng = np.random.default_rng(3)
    b = rng.integers(0, 256, E.BINS, dtype=np.uint8)
    c = b.copy()
    c[[0, 7, 40, 77, 120]] ^= 1
    rows = [(1000, b), (1001, c)]
    for k in range(E.BANDS):
        for i, like in enumerate((b, c)):
            head = rng.integers(0, 256, E.BINS, dtype=np.uint8)
            head[E.ROWS * k : E.ROWS * (k + 1)] = like[E.ROWS * k : E.ROWS * (k + 1)]
            rows.append((10 * k + i, head))
    prints = spark.createDataFrame([(i, f.tobytes().hex()) for i, f in rows], "doc_id long, fingerprint string")
    assert {(r["a"], r["b"]) for r in E.similar_documents(prints).collect()} == {(1000, 1001)}


def test_large_buckets_connect_as_all_pairs(spark):
    rng = np.random.default_rng(5)
    start = rng.integers(0, 256, E.BINS, dtype=np.uint8)
    sigs = []
    for _ in range(20):  # a family, alike in half of its bins: families of copies inside it, one bucket for all
        own = start.copy()
        own[E.BINS // 2 :] = rng.integers(0, 256, E.BINS // 2, dtype=np.uint8)
        for _ in range(3):
            x = own.copy()
            x[rng.integers(8, E.BINS, 12)] ^= 3
            sigs.append(x)
    members = spark.createDataFrame([(1, i, i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "bucket long, key long, mark long, sig binary")
    pairs = {(i, j) for j in range(60) for i in range(j) if (sigs[i] == sigs[j]).mean() >= 0.8}
    every = {tuple(r) for r in E.links_in_buckets(members, 0.8, forest=False, block=7).select("a", "b").collect()}
    assert every == pairs and len(pairs) > 20
    tops = lambda links: {i: min(j for j in range(60) if j in reach(i, links)) for i in range(60)}

    def reach(i, links):
        seen, queue = {i}, [i]
        while queue:
            k = queue.pop()
            for n in {x for p in links if k in p for x in p} - seen:
                seen.add(n)
                queue.append(n)
        return seen

    for block in (7, 512):
        forest = {tuple(r) for r in E.links_in_buckets(members, 0.8, forest=True, block=block).select("a", "b").collect()}
        assert forest <= pairs and tops(forest) == tops(pairs)


def test_ranges_are_alike_in_bytes(spark):
    """The long texts have the greatest ids; ranges of them have few rows, and one text beyond a range has one of its own."""
    rows = [(i, "x" * (40 if i < 3000 else 40_000)) for i in range(3060)] + [(5000, "y" * 900_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed = E.by_descending_id(docs, 400_000).where("__ahead = 0").groupBy("__range").agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("longest"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in placed) == len(rows) and len(placed) >= 6
    assert all(r["bytes"] <= 3 * 400_000 or r["n"] == 1 for r in placed if r["longest"] < 900_000)
    assert E.range_size(10**8) < E.range_size(10**9) < E.range_size(10**15) == E.RANGE_MOST and E.range_size(0) == 1
