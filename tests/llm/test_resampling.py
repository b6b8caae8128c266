"""Weights, scores and ranks against a plain pass over every word."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from martlib.llm import resampling as R
from tests.conftest import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text, most):
    words = WORD.findall(lowered(text))
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, most, buckets, least, percent):
    of = lambda run: zlib.crc32(run.encode()) % buckets
    s = Counter(of(r) for _, t in docs for r in runs(t, most)[0])
    t = Counter(of(r) for x in target for r in runs(x, most)[0])
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in s}
    out = []
    for k, text in docs:
        found, words = runs(text, most)
        weight = sum(gain[of(r)] for r in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((tuple(r) + (rank.get(id(r)),) for r in out), key=str)


def ran(spark, docs, target, most, buckets, least, percent):
    source = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS a", "2 AS row", "3 AS times", "4 AS __part", "'x' AS key")
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, row int")
    return sorted(rows(R.draw(R.add_score(R.weigh(source, aims, most=most, buckets=buckets)), least_words=least, percent=percent)), key=str)


TARGET = ["The cat sat on the mat.", None, "", "on the mat\nthe dog"]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_equals_plain_pass(spark, most):
    """Lines that repeat, runs that cross one, two and more lines, words cut by nothing, and every kind of empty text."""
    lines = ["the cat sat", "on THE mat", "", "  ", "naïve café 12ab", "x", "A-B_c", "\x00\x7f", "the cat sat", "İstanbul ſ   \x85 end"]
    docs = [(k, "\n".join(lines[(k * i) % len(lines)] for i in range(1, 2 + k % 9))) for k in range(60)]
    docs += [(60, None), (61, ""), (62, "\n\n\n"), (None, "no id here the cat"), (None, "another the mat"), (5, "the cat sat"), (5, "the cat sat"), (63, "one\r\ntwo\n\nthree"), (-4, "word " * 50)]
    assert ran(spark, docs, TARGET, most, 97, 3, 50) == plain(docs, TARGET, most, 97, 3, 50)


def test_pieces(spark, monkeypatch):
    """Texts far longer than a piece give the same runs."""
    text = "\n".join(" ".join(f"w{i * j % 53}" for j in range(i % 11)) for i in range(400))
    want = {most: (sorted(zlib.crc32(r.encode()) % 1000 for r in runs(text, most)[0]), runs(text, most)[1]) for most in (1, 2, 4)}
    monkeypatch.setattr(R, "PIECE", 64)
    for most, (buckets, words) in want.items():
        n, inside = R.features(text, most, 1000, {})
        assert (n, sorted(inside.tolist())) == (words, buckets)
        by_line = [b for line in text.split("\n") for b in R.features(line, most, 1000, {})[1].tolist()]
        crossing = R.features(text, most, 1000, {}, lines=True)[1].tolist()
        assert sorted(by_line + crossing) == buckets


def test_hot_lines(spark):
    """One line is most of the corpus: it is broadcast, the others are joined."""
    docs = [(k, f"the licence applies\nown line {k}\nthe licence applies") for k in range(1500)]
    assert ran(spark, docs, TARGET, 1, 1000, 2, 10) == plain(docs, TARGET, 1, 1000, 2, 10)


def test_empty_tables(spark):
    docs = [(1, "one two"), (2, None)]
    assert ran(spark, docs, [], 2, 10, 1, 100) == plain(docs, [], 2, 10, 1, 100)
    assert ran(spark, [], TARGET, 2, 10, 1, 100) == []


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(3, 30, 5), (1, 30, 5), (2, 30, 7), (None, 30, 5), (9, 1, 99), (4, 30, 1)], "doc_id long, n_words long, score long")
    assert rows(R.draw(scored, least_words=20, percent=80)) == rows(spark.createDataFrame([(3, 30, 5, 3), (1, 30, 5, 2), (2, 30, 7, 1), (None, 30, 5, 4), (9, 1, 99, None), (4, 30, 1, None)], "doc_id long, n_words long, score long, rank long"))
