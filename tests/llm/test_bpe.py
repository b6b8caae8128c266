import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from martlib.llm import bpe as B
from tests.llm.conftest import ROWS, tables


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(B.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    with open(B.vocabulary_path(), encoding="utf-8") as f:
        return B.Codec(f.read())


def some_texts():
    rng = random.Random(3)
    letters = "abcdefgh  \n\t'sd.,!?0123éßñ漢字\U0001f600\xa0\x00İ<|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)]


def test_ids_equal_the_library(library, codec, sf_dir):
    import pyarrow.parquet as pq

    texts = some_texts() + [r[1] or "" for r in ROWS] + pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't I'LL we've", "ab" * 3000, "the" * 500, "\U0001f600" * 100, "   x   "]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(t)
        assert ids == want.ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_long_parts_merge_like_short_ones(codec):
    rng = random.Random(4)
    for _ in range(200):
        ids = [codec.byte_ids[b] for b in bytes(rng.choice(b"aabtheringo ") for _ in range(rng.randint(2, 200)))]
        assert codec._short(list(ids)) == codec._long(list(ids))


def test_query(spark, odd, none, library, tmp_path):
    got = B.op4_bpe(spark, tables(spark, tmp_path, documents=odd)).collect()
    want = []
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert B.op4_bpe(spark, tables(spark, tmp_path / "none", documents=none)).count() == 0
    clash = odd.withColumnRenamed("lang", "IDS")
    assert B.encode_texts(clash).columns == ["doc_id", "text", "source", "n_chars", "n_tokens", "ids"]
