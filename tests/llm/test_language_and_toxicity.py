import math
import random
import unicodedata
import zlib
from collections import Counter

from pyspark.sql import functions as F

from martlib.llm import language_id as L
from martlib.llm import toxicity as X
from tests.llm.conftest import tables


def test_held_out_rows(spark):
    got = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", L.held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = L.op5_language_id(spark, d).where("held_out").join(truth, "doc_id").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_learns_nothing_from_held_out_rows(spark, tmp_path):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:60]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2][:20]
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", "xx" if i % 2 else "yy", "s", 10) for i in ids] + [(i, "alpha beta", "zz", "s", 10) for i in held]
    d = tables(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = L.op5_language_id(spark, d).collect()
    assert {r["lang_pred"] for r in got} == {"xx", "yy"}
    assert all(r["lang_pred"] == "xx" for r in got if r["held_out"])


def test_language_edge_cases(spark, odd, none, tmp_path):
    got = L.op5_language_id(spark, tables(spark, tmp_path, documents=odd)).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[11] == ("und", 0.0)
    assert by_id[None][0] is not None and {r["held_out"] for r in got if r["doc_id"] is None} == {True}
    assert L.op5_language_id(spark, tables(spark, tmp_path / "none", documents=none)).count() == 0
    clash = odd.withColumnRenamed("lang", "SCORE")
    assert L.identify_language(clash, L.Model([])).columns == ["doc_id", "text", "source", "n_chars", "lang_pred", "score"]


def test_unseen_words_back_off(spark):
    model = L.Model([("en", "thing", 9), ("en", "bring", 5), ("fr", "eaux", 9), ("fr", "beaux", 4)])
    predict = L.Predictor(model)
    assert predict("sting")[0] == "en" and predict("gateaux")[0] == "fr"
    assert predict("1234") == ("und", 0.0) and predict(None) == ("und", 0.0)
    assert 0 <= predict("漢字")[1] <= 1
    assert predict("½ ² Ⅷ ①") == predict("_ -") == ("und", 0.0)


def test_language_scores_do_not_depend_on_words_met_before():
    rng = random.Random(4)
    made = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 6, 9, 80]))) for _ in range(n))
    model = L.Model([(lang, w, 1 + len(w) % 3) for lang in ("aa", "bb", "cc") for w in set(made(60).split())])
    texts = [made(40) for _ in range(12)]
    alone = [L.Predictor(model)(t) for t in texts]
    together = L.Predictor(model)
    together(" ".join(texts[::2]))
    assert [together(t) for t in texts] == alone == [together(t) for t in texts]


def test_language_model_is_sparse():
    """Languages with words of their own: the model grows with words, not with words x languages."""
    counts = [(f"l{i:03d}", f"{'abcdefghij'[i % 10]}{i}w{j}", 2) for i in range(300) for j in range(40)]
    model = L.Model(counts)
    assert len(model.words) == len(model.word_gains.gains) == len(counts) and len(model.gram_gains.gains) < 40 * len(counts)
    assert L.Predictor(model)(counts[4567][1].replace("4", "b"))[1] <= 1


def test_language_equals_a_plain_way(spark):
    """Counts, model and scores from scratch, with nothing but dictionaries."""
    rng = random.Random(3)
    made = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 30)))
    rows = [(i, made(letters) + rng.choice([" 12½", "", "! X²y"]), lang) for i in range(60) for lang, letters in [rng.choice([("aa", "abcdeé"), ("bb", "cdefgß"), ("cc", "efghij")])]]
    rows += [(100, "only one text speaks it", "rare"), (101, None, "aa"), (102, "no language", None)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    split = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()
    words, grams = Counter(), Counter()
    for _, t, lang in rows:
        if t and lang:
            for w in split(t):
                words[lang, w] += 1
                for n in range(1, 5):
                    for k in range(len(w) + 3 - n):
                        grams[lang, n, f" {w} "[k : k + n]] += 1
    langs = ["aa", "bb", "cc", "rare"]
    known, seen = {w for _, w in words}, {(n, g) for _, n, g in grams}

    def log(counts, key, lang, of):
        every = {k[1:] for k in counts if of(k)}
        return math.log((counts.get((lang, *key), 0) + 0.1) / (sum(v for k, v in counts.items() if k[0] == lang and of(k)) + 0.1 * len(every)))

    def score(word, lang):
        if word in known:
            return log(words, (word,), lang, lambda k: True)
        w, total = f" {word} ", 0.0
        for end in range(2, len(w) + 1):
            n = next((n for n in range(min(4, end), 0, -1) if (n, w[end - n : end]) in seen), 0)
            total += log(grams, (n, w[end - n : end]), lang, lambda k: k[1] == n) + (4 - n) * math.log(0.4) if n else 0.0
        return total * 2 / (len(w) - 1)

    predict = L.Predictor(model)
    assert model.langs == langs
    for text in ["abc deé", "fghij zz new", "only speaks", rows[0][1], "Cß a1b ÉÉ"]:
        totals = [sum(score(w, lang) for w in split(text)) for lang in langs]
        best = max(range(4), key=lambda i: totals[i])
        want = 1 / sum(math.exp((t - totals[best]) / math.sqrt(len(split(text)))) for t in totals)
        got = predict(text)
        assert got[0] == langs[best] and abs(got[1] - want) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = X.op9_toxicity(spark, d).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_toxicity_edge_cases(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, 1, None), (None, 1, 1), (5, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = X.op9_toxicity(spark, tables(spark, tmp_path, documents=odd, labels=labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == 0.0 and by_id[6] == by_id[7]
    assert X.op9_toxicity(spark, tables(spark, tmp_path / "none", documents=none, labels=labels.limit(0))).count() == 0


def test_gradients_match_differences():
    import numpy as np

    net = X.Network(["bad", "good", "fine"])
    for k in net.P:
        net.P[k] = net.P[k].astype(np.float64)
    windows, y = [["bad", "good", "new"], ["fine"], ["good", "fine"]], np.array([1.0, 0.0, 0.0])

    def loss():
        scorer = X.Scorer(net)
        p = np.zeros(len(windows))
        for i, q in scorer.windows(windows):
            p[i] = q
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    trainer = X.Trainer(net)
    before = {k: v.copy() for k, v in net.P.items()}
    trainer.step(windows, y)
    grads = {k: m / 0.1 for k, m in trainer.m.items()}
    for k, v in before.items():
        net.P[k] = v
    rng = np.random.default_rng(0)
    for k in ("att", "out", "Wf", "Ub", "cb", "word"):
        at = tuple(rng.integers(0, s) for s in before[k].shape)
        while abs(grads[k][at]) < 1e-6:
            at = tuple(rng.integers(0, s) for s in before[k].shape)
        eps = 1e-2
        net.P[k][at] += eps
        up = loss()
        net.P[k][at] -= 2 * eps
        down = loss()
        net.P[k][at] += eps
        assert abs((up - down) / (2 * eps) - grads[k][at]) < 2e-3 + 0.02 * abs(grads[k][at]), k


def test_toxicity_equals_a_plain_network(spark):
    """Scores of trained weights, one word at a time in plain loops; the highest window counts."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("good", "bad", "ugly", "plain") for b in ("ing", "er", "s", "")]
    rows = [(" ".join(rng.choice(words[:4] + words[8:]) for _ in range(30)) + (" bad bader" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    net = X.train(rows)
    P, h = net.P, X.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))

    def states(xs, way):
        s, out = [0.0] * h, []
        for x in xs:
            gates = [sum(x[d] * P[f"W{way}"][d, g] for d in range(len(x))) + P[f"c{way}"][g] for g in range(3 * h)]
            z, r = ([sig(gates[o + k] + sum(s[d] * P[f"U{way}"][d, o + k] for d in range(h))) for k in range(h)] for o in (0, h))
            new = [math.tanh(gates[2 * h + k] + sum(r[d] * s[d] * P[f"U{way}"][d, 2 * h + k] for d in range(h))) for k in range(h)]
            s = [s[k] + z[k] * (new[k] - s[k]) for k in range(h)]
            out.append(s)
        return out

    def window(some):
        xs = [net.embed([w])[0] for w in some]
        both = [a + b for a, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        weights = [math.exp(sum(a * v for a, v in zip(P["att"], s, strict=True))) for s in both]
        pooled = [sum(w * s[k] for w, s in zip(weights, both, strict=True)) / sum(weights) for k in range(2 * h)]
        return sig(sum(a * b for a, b in zip(P["out"], pooled, strict=True)) + P["bias"][0])

    texts = [rows[0][0], "bad", "good plain unknown", " ".join(w for t, _ in rows[:4] for w in t.split()), ""]
    got = X.Scorer(net).texts(texts)
    for text, score in zip(texts, got, strict=True):
        some = text.split()
        starts = range(0, max(1, len(some) - X.WINDOW + X.STRIDE), X.STRIDE)
        want = max(window(some[min(s, max(0, len(some) - X.WINDOW)) :][: X.WINDOW]) for s in starts) if some else 0.0
        assert abs(score - want) < 1e-4
    assert got[0] > got[2]


def test_windows_cover_all_words():
    for n in (0, 1, X.WINDOW - 1, X.WINDOW, X.WINDOW + 1, 1000):
        spans = X.windows_of(n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n)) and all(b - a <= X.WINDOW for a, b in spans)
