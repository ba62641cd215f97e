import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echolex.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
ODD = [
    "", " ", "<|endoftext|> x", "a\x1cb \x1d c", "\u0085x   y  ", "'S 's it's don't", "   \n\n  \t x", "a" * 5000, " " * 300 + "x",
    "ｅ́é 🤖👩‍👩‍👧 漢字", "\r\n\r\nx y", "﻿x​ y", "1²½Ⅷ x", "\x00\x01", "ab" * 20_000, "x" * 300_000, "　　x", "''ll'", "don''t 've",
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_odd_texts(reference):
    assert bpe.encoder(bpe.vocabulary_path()).encode_batch(ODD) == [reference(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(reference, texts):
    encoder = bpe.encoder(bpe.vocabulary_path())
    assert encoder.encode_batch(texts) == [reference(t) for t in texts]
    assert encoder.count_batch(texts) == [len(reference(t)) for t in texts]


def test_round_trip():
    path = os.path.join(bpe.TOKENIZER_FOLDER, "byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        piece = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    for text, ids in zip(ODD, bpe.encoder(bpe.vocabulary_path()).encode_batch(ODD)):
        assert b"".join(piece[i] for i in ids).decode() == text


def test_a_full_cache_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    encoder = bpe.PairIndexEncoder(bpe.vocabulary_path())
    assert [encoder.encode_batch([t])[0] for t in ODD] == [reference(t) for t in ODD]


def test_whole_documents(spark, reference):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(documents).collect()}
    assert got == {i: reference(t) if t else [] for i, t in texts.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(documents).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}


def test_nulls_repeats_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, 2), (1, "", 2), (None, "a b", 3), (4, "a b", 3)], "doc_id int, text string, ids int")
    out = sorted(((r["doc_id"] or 0), r["ids"]) for r in bpe.encode(rows).collect())
    assert out[1:3] == [(1, []), (1, [])] and out[0][1] == out[3][1] != []
    assert bpe.encode(rows.limit(0)).count() == 0
