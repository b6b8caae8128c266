"""From raw documents to token ids: toxicity, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir), docs being the documents that the stage before it kept, and returns documents with
the columns it got; the last returns tokens. run() writes each stage's rows as Parquet and reads them again for the next.
Every stage gives an empty table for an empty one; all but the last keep further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.bpe import encode_texts
from martlib.llm.common import materialize, own_prefix, read
from martlib.llm.mixing import mix
from martlib.llm.near_copies import group_heads
from martlib.llm.secret_scan import mask_secrets
from martlib.llm.toxicity import score_toxicity, train, training_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not call toxic. It learns from labelled documents that are not held out."""
    net = train(training_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("judged"))
    scored = score_toxicity(packed, net, text="judged", drop=("judged",))
    return scored.where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (near_copies: five-word shingles, similarity 0.8 or more), the document with the least id.
    Rows without an id have no group and stay. Of rows with one id, those of different texts are documents of their own; of
    rows with one id and one text the least in order of all columns stays."""
    known = docs.where("doc_id IS NOT NULL")
    heads = materialize(group_heads(known), "heads")
    same = lambda some: (known["doc_id"] == some["key"]) & (F.xxhash64(known["text"]) == some["print"])
    single, repeated = heads.where("n = 1"), heads.where("n > 1")
    kept = known.join(single, same(single), "left_semi")
    if not repeated.isEmpty():
        ordered = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
        first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), ordered).alias("row")
        some = known.join(repeated, same(repeated), "left_semi")
        kept = kept.unionByName(some.groupBy("doc_id", F.xxhash64("text")).agg(first).select("row.*"))
    return kept.unionByName(docs.where("doc_id IS NULL"))


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars is the new length."""
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of one epoch at most that make up the target mixture. A row without an id is drawn by a hash of its text,
    so rows without an id and of one text are drawn together."""
    key = F.coalesce("doc_id", F.xxhash64("text"))
    own = own_prefix(docs.columns) + "drawn"
    drawn = mix(docs.select(key.alias("doc_id"), "text", "lang", "source"), max_epochs=1).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(drawn, key == F.col(own), "left_semi")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of ids and of the decoded text."""
    return encode_texts(docs.select("doc_id", "text"), columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), drop=("text",))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_found_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]
#: Networks, fingerprints and tokens are not SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
