"""Quality rules: a threshold table compiled into one projection of ratios; no user functions.

Words are `[^\\x20\\x09-\\x0D]+`. Every rule reads: the document is dropped if ratio < low or ratio > high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlib.llm.common import read, without

#: Frequent function words of English, German, French and Spanish, in alphabetical order by language.
STOP_WORDS = (
    "a and are as at be by for from in is it of on that the this to was with",
    "an auf das den der des die ein eine für in ist mit nicht sich und von zu",
    "avec dans de des du elle en est et la le les par pas pour que qui sur un une",
    "con de del el en es la las lo los no para por que se su un una y",
)
#: (name, ratio, low, high). None: no bound on that side. The ratios are the keys of _ratios().
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "chars_per_word", 1.5, 15.0),
    ("symbols", "symbols_per_word", None, 0.5),
    ("exclamations", "exclamations_per_word", None, 0.5),
    ("letters", "letters_per_char", 0.4, None),
    ("stop_words", "stop_words_per_word", 0.01, None),
    ("duplicate_lines", "duplicate_lines_per_line", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACE = "[\\x20\\x09-\\x0D]"
_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"]


def _windows(words: str) -> Column:
    """64-bit hashes of the three-word windows; in one text of 20,000 words two different ones meet by chance in 1 of 10^11."""
    w = lambda i: F.get(words, i)
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(w(i), w(i + 1), w(i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return {
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "exclamations_per_word": per("__exclamations", "n_words"),
        "letters_per_char": per("__letters", "word_chars"),
        "stop_words_per_word": per("__stops", "n_words"),
        "duplicate_lines_per_line": per("n_dup_lines", "__lines"),
    }


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one array of the names of the rules that a row breaks."""
    ratios = _ratios()
    broken = [
        F.when((ratios[r] < F.lit(low) if low is not None else F.lit(False)) | (ratios[r] > F.lit(high) if high is not None else F.lit(False)), F.lit(name))
        for name, r, low, high in rules
    ]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def add_quality(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules and kept.

    Null texts count as texts without words. A text without words has base_failed true. A ratio over nothing (no words,
    no lines) breaks no rule. Repeated rows are judged each for itself; an empty table gives an empty table; other columns
    pass through, and input columns with the names above are replaced. Names that begin with two underscores are this function's
    own: input columns of its names (__t, __words, __line, ...) are replaced and dropped. A very long text is one row of arrays.
    """
    stops = sorted({w for line in STOP_WORDS for w in line.split()})
    t, whole = F.col("__t"), F.array_join("__words", "")
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    df = without(df.withColumn("__t", F.coalesce(F.col(text), F.lit(""))), _COLUMNS)
    df = df.withColumns({"__words": F.filter(F.split(t, f"{_SPACE}+"), lambda w: w != ""), "__line": lines})
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(whole).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__line") - F.size(F.array_distinct("__line"))).cast("long"),
        "__exclamations": F.regexp_count(t, F.lit("!")),
        "__letters": F.char_length(F.regexp_replace(whole, "\\P{L}+", "")),
        "__stops": F.size(F.filter("__words", lambda w: F.lower(w).isin(stops))),
        "__lines": F.size("__line"),
        "__windows": _windows("__words"),
    }).drop("__words", "__line", "__t")
    # Windows that recur: sorted by (hash, place), equal hashes stand side by side. Most texts have none and skip this.
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("__pairs", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), pairs)).drop("__windows")
    again = F.filter("__pairs", lambda x, i: F.get("__pairs", i - 1)["h"].eqNullSafe(x["h"]) | F.get("__pairs", i + 1)["h"].eqNullSafe(x["h"]))
    df = df.withColumn("__places", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("__pairs")
    # A window covers three words; up to the next recurring window it adds at most the distance to it.
    fresh = F.transform("__places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__places", i + 1) - p, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(fresh, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("__places")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "failed_rules": compile_rules(rules)})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__exclamations", "__letters", "__stops", "__lines")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return add_quality(docs).select("doc_id", *[c for c in _COLUMNS if c != "failed_rules"], F.array_join("failed_rules", ",").alias("failed_rules"))


#: The same in DuckDB; words and lines as above, windows by their text.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + d AS p FROM again, (VALUES (0), (1), (2)) v(d)) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             length(text) - length(replace(text, '!', '')) AS bangs, len(lines) AS n_lines,
             length(regexp_replace(array_to_string(words, ''), '\P{L}+', '', 'g')) AS letters,
             len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS stops
      FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             concat_ws(',', CASE WHEN word_chars / nullif(n_words, 0) < 1.5 OR word_chars / nullif(n_words, 0) > 15.0 THEN 'mean_word_length' END,
                       CASE WHEN n_symbols / nullif(n_words, 0) > 0.5 THEN 'symbols' END,
                       CASE WHEN bangs / nullif(n_words, 0) > 0.5 THEN 'exclamations' END,
                       CASE WHEN letters / nullif(word_chars, 0) < 0.4 THEN 'letters' END,
                       CASE WHEN stops / nullif(n_words, 0) < 0.01 THEN 'stop_words' END,
                       CASE WHEN n_dup_lines / nullif(n_lines, 0) > 0.5 THEN 'duplicate_lines' END) AS failed_rules FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
""".replace("{stops}", ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS for w in line.split()})))
