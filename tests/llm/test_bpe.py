import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from reelstate.llm import bpe, queries

TEXTS = ["", None, " ", "  ", "a  b", "foo   bar  ", "x\x1c y\x1c\x1d z", "!\x1c!",
         "a<|endoftext|> b <|endoftext|>  <|endoftext|>\n\n", "it's we'll  'S\t\tx\r\n  y",
         "日本語 テスト 🎉🎉  🎉", "​ a​  b", "﻿ x᠎ y", "é à  12 3½ ²", "\x00 \x00",
         "word " * 5000, "x" * 20_000, " " * 20_000 + "y", "same text", "same text"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.vocabulary())


def one(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def random_texts():
    r = random.Random(1)
    letters = [*"ab1! '\n\t\r\x85\xa0 　\x1c\x1d​é日😀.", "<|endoftext|>", "'s"]
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(3000)]


def test_against_the_library(spark, tokenizer):
    texts = TEXTS + random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.encoded(df, block_bytes=3000, share_bytes=5000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == one(texts[r.doc_id], tokenizer)
        assert r.text == (texts[r.doc_id] or "") and len(r.ids) == r.n_tokens


def test_query_against_the_library(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_bpe"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {
        k: one(t, tokenizer) for k, t in texts.items()}


def test_round_trip_and_bytes_that_are_no_text(spark, tokenizer):
    df = spark.createDataFrame([(1, "é日 two"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df)).collect()}
    assert back == {1: "é日 two", 2: ""}
    ids = tokenizer.encode("日", add_special_tokens=False).ids[:1]
    tokens = spark.createDataFrame([(1, ids), (2, None), (3, [50256])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decoded(tokens).collect()}
    assert got == {1: tokenizer.decode(ids), 2: "", 3: "<|endoftext|>"}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "x")] * 3 + [(None, "c", "y")],
                               "doc_id long, text string, block string")
    rows = bpe.encoded(df, block_bytes=1).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == [(1, "a b")] * 3 + [(None, "c")]
    assert bpe.encoded(df.limit(0)).count() == 0


def test_packing():
    for values in ([], [0], [1, 300, 70_000, 2**32 - 1], list(range(1000))):
        assert bpe.unpacked(bpe.packed(values)).tolist() == values
    for words in ([], ["a"], ["", "é", " 日本", "\n"]):
        assert bpe.unpacked_words(bpe.packed_words(words)) == words
