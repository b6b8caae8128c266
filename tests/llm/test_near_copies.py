import random

import corpus_pipeline as P
from martlib.llm import near_copies as N

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(texts):
    """{position: positions of its group} by all pairs of plain shingle sets."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(5, len(words) - 5), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def made(rng):
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        texts += [" ".join(base), *[" ".join(changed(rng, base, n)) for n in (1, 1, 2, 2, 3, 4, 8)]]
    # A family with a long start in common, and pairs inside it that differ in a word.
    start = [f"s{k}" for k in range(60)]
    for _ in range(25):
        own = start + [f"w{rng.randrange(5000)}" for _ in range(60)]
        texts += [" ".join(own), " ".join(changed(rng, own, 1))]
    return [*texts, None, "", " \n", "a b", "A  B", "a b c d e", "a b c d e f"]


def test_edited_copies_go(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(1, base), (2, changed(rng, base, 1)), (3, changed(rng, base, 2)), (4, changed(rng, base, 12)), (5, base[::-1])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], DOCS)
    assert sorted(r["doc_id"] for r in P.drop_near_copies(spark, docs, "").collect()) == [1, 4, 5]


def test_groups_equal_all_pairs(spark):
    texts = made(random.Random(8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    of = {r["words"]: r["root"] for r in N.near_copy_groups(docs)[1].collect()}
    got, want = [of[N.words_digest(t)] for t in texts], groups(texts)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) < len(texts)


def test_no_texts(spark):
    assert [x.count() for x in N.near_copy_groups(spark.createDataFrame([], "doc_id long, text string"))] == [0, 0]


def test_cells_connect_as_all_pairs(spark, monkeypatch):
    """Cells of any size; a family of texts that are 0.7 to 0.9 alike, no one of them alike to all."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(changed(rng, base, rng.choice((2, 4, 6, 8)))) for _ in range(60)]
    want = groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for members in (7, 512):
        monkeypatch.setattr(N, "MEMBERS", members)
        of = {r["words"]: r["root"] for r in N.near_copy_groups(docs)[1].collect()}
        got = [of[N.words_digest(t)] for t in texts]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) and 1 < len(set(want)) < 60


def test_one_id_with_two_texts(spark):
    rng = random.Random(6)
    a, b = ([f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(a), "en", "s", 1), (1, " ".join(b), "en", "s", 2), (1, " ".join(b), "en", "s", 2), (2, " ".join(b).upper(), "en", "s", 3), (1, " ".join(a), "aa", "s", 1)]
    kept = [tuple(r)[:3] for r in P.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    assert sorted(kept) == sorted([(1, " ".join(a), "aa"), (1, " ".join(b), "en")])
