"""Language identification by known words first, then by ever shorter character n-grams.

Spark counts, per language, the words and the n-grams (lengths MAX_GRAM to 1, with word boundaries) of a bounded sample of
documents; the model keeps all that the sample has. A word that training knows scores its smoothed log frequency in each
language. Any other word is walked from left to right: at each position the longest known n-gram that ends there is used,
else the next shorter one at a fixed cost. A text scores the sum over its words; its score is the posterior of the best
language for a text of the same average word. Words are runs of letters, in training and afterwards.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.common import map_texts, materialize, read

#: Bounds of the labelled rows that are learned from: about SAMPLE_DOCS documents of a language and SAMPLE_ROWS of all languages
#: together, drawn by hash, none over SAMPLE_CHARS code points and about SAMPLE_TEXT in all.
SAMPLE_DOCS, SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TEXT, MAX_GRAM = 600, 60_000, 200_000, 50_000_000, 4
#: Numbers that a worker keeps for unseen words that it has met; numbers that are added up at once; letters of a word that is not long.
CACHE_VALUES, BLOCK_VALUES, SHORT = 8_000_000, 2_000_000, 64
BACKOFF, UNKNOWN = math.log(0.4), "und"
_WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def grams_of(word: str) -> Iterable[str]:
    w = f" {word} "
    return (w[i : i + size] for size in range(1, MAX_GRAM + 1) for i in range(len(w) - size + 1))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS, sample_text: int = SAMPLE_TEXT) -> Model:
    """A model of the languages of docs, counted by Spark in a sample drawn by hash of the key (rows without a key by their text).

    Every language has a share of the sample, in rows and in text; the rare ones have all of their documents. Rows without a language or text, or over
    SAMPLE_CHARS, teach nothing; where there are so many languages that one text is a good part of a share, a language of few texts
    may be left out. More languages than sample_rows are an error: such a column holds something else.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.char_length(text) <= SAMPLE_CHARS))
    sizes = known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"), F.sum(F.char_length(text)).alias("chars"))
    languages = sizes.agg(F.count("*").alias("k"))
    room = F.when(F.col("k") <= sample_rows, F.least(F.lit(sample_docs), F.lit(float(sample_rows)) / F.col("k"))).otherwise(F.raise_error(F.lit(f"more than {sample_rows} languages")).cast("double"))
    shares = sizes.crossJoin(F.broadcast(languages)).select("lang", F.least(room / F.col("n"), F.lit(float(sample_text)) / F.col("k") / F.greatest("chars", F.lit(1))).alias("share"))  # one row
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text)), F.lit("langid")), 11) / F.lit(2.0**53)
    # A row for each language, sample_rows at most: above, the shares fail. The texts stay where they are.
    drawn = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("place")).join(F.broadcast(shares), "lang").where("place < share")
    words = drawn.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = materialize(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    w = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def of_size(size: int):
        starts = F.sequence(F.lit(1), F.char_length("word") + 3 - size)
        return F.when(F.char_length("word") + 2 >= size, F.transform(starts, lambda i: F.substring(w, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*[of_size(size) for size in range(1, MAX_GRAM + 1)])
    of_grams = counts.select("lang", F.explode(grams).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(counts.select("lang", "word", "n").toArrow(), of_grams.select("lang", "gram", "n").toArrow())


def _in_columns(rows: Iterable[tuple[str, str, int]] | pa.Table) -> pa.Table:
    """lang, name, n in order of name and lang."""
    if not isinstance(rows, pa.Table):
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        rows = pa.table([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "name", "n"])
    return rows.rename_columns(["lang", "name", "n"]).sort_by([("name", "ascending"), ("lang", "ascending")]).combine_chunks()


class Gains:
    """Sparse rows: row i has the entries starts[i] to starts[i + 1] of langs and gains."""

    def __init__(self, starts: np.ndarray, langs: np.ndarray, gains: np.ndarray):
        self.starts, self.langs, self.gains = starts, langs, gains

    def totals(self, rows: np.ndarray, times: np.ndarray, of: np.ndarray, groups: int, k: int) -> np.ndarray:
        """(groups, k): the sums of the rows of each group (of), each row so many times; BLOCK_VALUES at a time."""
        out, block = np.zeros(groups * k), max(1, BLOCK_VALUES // k)
        for i in range(0, len(rows), block):
            part = slice(i, i + block)
            first = self.starts[rows[part]]
            n = self.starts[rows[part] + 1] - first
            ends = n.cumsum()
            at = (first - ends + n).repeat(n)
            at += np.arange(len(at))
            out += np.bincount(self.langs[at] + (of[part] * k).repeat(n), self.gains[at] * times[part].repeat(n), minlength=groups * k)
        return out.reshape(groups, k)


class Model:
    """Log frequencies by language; langs are the learned values in order.

    A name that a language never had has that language's floor of its kind (floors[0] for words, floors[n] for n-grams), and only
    what other languages have above their floors is kept, so the model grows with the counts and not with names x languages.
    words and grams name the rows of word_gains and gram_gains; grams are in order of length.
    """

    def __init__(self, counts: Iterable[tuple[str, str, int]] | pa.Table, grams: Iterable[tuple[str, str, int]] | pa.Table | None = None):
        counts = _in_columns(counts)
        if grams is None:
            summed: Counter[tuple[str, str]] = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in counts.columns), strict=True):
                for g in grams_of(word):
                    summed[lang, g] += n
            grams = [(*k, n) for k, n in summed.items()]
        grams = _in_columns(grams)
        self.langs = sorted(pc.unique(counts["lang"]).to_pylist())
        self.k = len(self.langs)
        self.floors = np.zeros((MAX_GRAM + 1, self.k))
        self.words, self.word_gains = self._part(counts, 0)
        sizes = pc.utf8_length(grams["name"])
        parts = [self._part(grams.filter(pc.equal(sizes, size)), size) for size in range(1, MAX_GRAM + 1)]
        self.grams = pa.concat_arrays([names for names, _ in parts])
        ends = np.cumsum([0, *(len(g.langs) for _, g in parts)])
        self.gram_gains = Gains(
            np.concatenate([*(g.starts[:-1] + e for (_, g), e in zip(parts, ends, strict=False)), ends[-1:]]), np.concatenate([g.langs for _, g in parts]), np.concatenate([g.gains for _, g in parts])
        )

    def _part(self, counts: pa.Table, kind: int) -> tuple[pa.Array, Gains]:
        """The names of one kind and their rows; sets the floors of that kind."""
        n = counts["n"].to_numpy().astype(np.float64)
        langs = pc.index_in(counts["lang"], pa.array(self.langs, pa.string())).to_numpy().astype(np.int32)
        coded = pc.dictionary_encode(counts["name"]).combine_chunks()
        names, codes = (coded.dictionary, coded.indices.to_numpy()) if len(counts) else (pa.array([], pa.string()), np.zeros(0, np.int32))
        if len(names):
            self.floors[kind] = np.log(0.1 / (np.bincount(langs, n, minlength=self.k) + 0.1 * len(names))) + (BACKOFF * (MAX_GRAM - kind) if kind else 0.0)
        return names.cast(pa.string()), Gains(np.searchsorted(codes, np.arange(len(names) + 1)), langs, np.log((n + 0.1) / 0.1))


class Predictor:
    """A model with the scores of words already met."""

    def __init__(self, model: Model):
        self.model = model
        self.gram_at = {g: i for i, g in enumerate(model.grams.to_pylist())}
        self.word_at = {w: i for i, w in enumerate(model.words.to_pylist())}
        self.met: dict[str, np.ndarray] = {}

    def unseen(self, words: list[str]) -> np.ndarray:
        """(words, k): what each word scores by its n-grams, the longest known one at each position."""
        at, found, of, sizes = self.gram_at, [], [], np.zeros((len(words), MAX_GRAM + 1))
        for i, word in enumerate(words):
            w, before = f" {word} ", len(found)
            taken = [0] * (MAX_GRAM + 1)
            for end in range(2, len(w) + 1):
                for start in range(max(0, end - MAX_GRAM), end):
                    if (g := at.get(w[start:end])) is not None:
                        found.append(g)
                        taken[end - start] += 1
                        break
            of.extend([i] * (len(found) - before))
            sizes[i] = taken
        total = self.model.gram_gains.totals(np.array(found, np.int64), np.ones(len(found)), np.array(of, np.int64), len(words), self.model.k)
        for size in range(1, MAX_GRAM + 1):
            total += sizes[:, size, None] * self.model.floors[size]
        return total * (2 / (np.array([len(w) for w in words]) + 1))[:, None]  # an unseen word weighs less than a known one

    def _unseen(self, counts: dict[str, int]) -> np.ndarray:
        """The sum of unseen words, each so many times, in their order. What a word scores is kept until CACHE_VALUES numbers are, and
        does not depend on the words that it is scored with: a block holds all n-grams of the short words of a step."""
        k, words, total = self.model.k, list(counts), np.zeros(self.model.k)
        step = max(1, BLOCK_VALUES // k // (SHORT + 1))
        for i in range(0, len(words), step):
            some = words[i : i + step]
            if (len(self.met) + len(some)) * max(k, 32) > CACHE_VALUES:
                self.met.clear()
            new = [w for w in some if w not in self.met]
            short = [w for w in new if len(w) <= SHORT]
            if short:
                self.met.update(zip(short, self.unseen(short), strict=True))
            if len(short) < len(new):
                self.met.update((w, self.unseen([w])[0]) for w in new if len(w) > SHORT)
            total += np.array([counts[w] for w in some], np.float64) @ np.array([self.met[w] for w in some])
        return total

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        k = self.model.k
        if not words or not k:
            return UNKNOWN, 0.0
        at, counts = self.word_at, Counter(words)
        known = [w for w in counts if w in at]
        times = np.array([counts[w] for w in known], np.float64)
        total = self.model.word_gains.totals(np.array([at[w] for w in known], np.int64), times, np.zeros(len(known), np.int64), 1, k)[0] + times.sum() * self.model.floors[0]
        if len(known) < len(counts):
            total += self._unseen({w: n for w, n in counts.items() if w not in at})
        best = int(np.argmax(total))
        scaled = (total - total[best]) / math.sqrt(len(words))
        return self.model.langs[best], float(1.0 / np.exp(scaled).sum())


def identify_language(df: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append lang_pred and score to every row of df, from whole texts alone.

    Null texts, texts without a letter, and all texts if nothing was learned: `und` and 0. Equal texts get equal results;
    ties go to the first language in alphabetical order; other columns pass through, and input columns named lang_pred or
    score are replaced. An empty table gives an empty table.
    """
    shared, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        predict = _predictor(name, shared)
        return lambda texts: list(map(list, zip(*map(predict, texts), strict=True)))

    return map_texts(df, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, drop)


_LAST: list = [None, None]


def _predictor(name: str, shared) -> Predictor:
    """One predictor in a worker for the model in use."""
    if _LAST[0] != name:
        _LAST[:] = [name, Predictor(shared.value)]
    return _LAST[1]


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model, drop=("text",))
