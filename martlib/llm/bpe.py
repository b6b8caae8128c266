"""Byte-level BPE encoding and decoding with a given vocabulary file; texts are cut and merged here, in plain Python.

A short part keeps its boundaries and the ranks of neighbouring pairs in two contiguous lists: find the least rank, drop
that boundary, refresh the ranks to its left and right. Parts over LONG_PART bytes use a heap of pairs instead, with the
same result in n log n steps. Parts recur, so each worker keeps those it has encoded, up to CACHE_PARTS of them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.common import map_texts, read

#: Fixed value: how the byte-level pre-tokenizer cuts text.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_PART, CACHE_PARTS = 96, 200_000
NO_RANK = 1 << 62


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next one from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary; source is the text of its tokenizer JSON."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes: dict[int, bytes] = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items() if all(c in of_letter for c in t)}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile(PARTS)
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def part(self, text: str) -> tuple[int, ...]:
        ids = [self.byte_ids[b] for b in text.encode("utf-8")]
        if len(ids) < 2:
            return tuple(ids)
        return tuple(self._short(ids) if len(ids) <= LONG_PART else self._long(ids))

    def _short(self, ids: list[int]) -> list[int]:
        pairs, none = self.pairs, (NO_RANK, 0)
        ranks = [pairs.get(p, none)[0] for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            ids[at] = pairs[ids[at], ids[at + 1]][1]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = pairs.get((ids[at - 1], ids[at]), none)[0]
            if at < len(ranks):
                ranks[at] = pairs.get((ids[at], ids[at + 1]), none)[0]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := pairs.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[y]))
        return [i for i in ids if i != -1]

    def _plain(self, text: str, out: list[int]) -> None:
        known = self.known
        for p in self.cut.findall(text):
            got = known.get(p)
            if got is None:
                got = self.part(p)
                if len(p) <= LONG_PART:
                    if len(known) >= CACHE_PARTS:
                        known.clear()
                    known[p] = got
            out += got

    def encode(self, text: str) -> list[int]:
        """Token ids; the strings of added tokens become their ids."""
        out: list[int] = []
        at = 0
        if self.stops:
            for m in self.stops.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.special[m[0]])
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(source: str) -> Codec:
    return Codec(source)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


FIELDS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, columns: tuple[str, ...] = ("n_tokens", "ids"), drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns of FIELDS: the ids of each text, their number, what they decode to, and digests of both.

    path: a byte-level BPE file of the tokenizers library, read by the driver and broadcast (its size is the vocabulary's,
    whatever the corpus). Null counts as empty, which has no ids. Repeated rows each give a row; an empty table gives an
    empty table; other columns pass through, and input columns with these names are replaced.
    """
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    decode = any(c.startswith("decoded") for c in columns)

    def make() -> Callable:
        codec = _codec(source.value)

        def one(t):
            ids = codec.encode(t or "")
            back = codec.decode(ids) if decode else ""
            made = {"n_tokens": len(ids), "ids": ids, "decoded": back}
            if "ids_sha256" in columns:
                made["ids_sha256"] = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            if "decoded_sha256" in columns:
                made["decoded_sha256"] = hashlib.sha256(back.encode("utf-8")).hexdigest()
            return [made[c] for c in columns]

        return lambda texts: list(map(list, zip(*map(one, texts), strict=True)))

    return map_texts(df, text, [T.StructField(c, FIELDS[c]) for c in columns], make, drop)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, columns=("n_tokens", "ids_sha256", "decoded_sha256"), drop=("text",)).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
