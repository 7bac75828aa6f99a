"""Byte-pair encoding against the vocabulary's own library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(1)
    texts = [None, "", "a<|endoftext|><|endoftext|> b<|endoftext", "x" * 5_000, "ab" * 3_000, " " * 200_000 + "x", "\n" * 1_000, " \t" * 500 + "z", "0" * 777]
    texts += ["՘࢏౜漢字" * 300, "é" * 100, "don't we'LL I'm", " \u0085  a", "😀" * 50, "\x00\x1c\x1d a\x1e", "İSTANBUL ǅ", "long " * 60_000]
    for _ in range(150):
        texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x10000, 0x1FA00), 32, 10])) for _ in range(200)))
    return texts + ["".join(rng.choice("abehinort") for _ in range(n)) for n in range(1, 150)]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    packed = np.array(ids, "<u4").tobytes()
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_few_remembered_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Vocabulary(bpe.vocabulary_path())
    for text in odd_texts() * 2:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
        assert len(coder) + len(coder.older) <= 6


def test_digests_equal_the_library(spark, library):
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (1, "again"), (1, "again")]
    got = bpe.round_trip_digests(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *expected(library, t))) for i, t in rows)
    assert bpe.round_trip_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip_digests(docs).collect()}
    assert got == {r["doc_id"]: expected(library, r["text"]) for r in docs.collect()}


def test_short_and_long_words_merge_alike():
    merges = bpe.vocabulary(bpe.vocabulary_path()).merges
    rng = random.Random(3)
    for n in range(1, 200):
        word = bytes(rng.choice(b"abcdehinorst ") for _ in range(n))
        assert merges.short(word) == merges.long(word)


def test_encoded_and_decoded_columns(spark, library):
    rows = [(i, t, "kept", [7]) for i, t in enumerate(odd_texts()[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids array<int>")
    coded = bpe.encoded(docs, batch_bytes=64)
    assert coded.columns == ["doc_id", "text", "lang", "ids"]
    for r in coded.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["lang"] == "kept"
    back = bpe.decoded(coded.withColumnRenamed("text", "original"), batch_bytes=64)
    assert back.where("text <> coalesce(original, '')").count() == 0 and back.count() == len(rows)


def test_decoding_any_ids(spark, library):
    rng = random.Random(4)
    rows = [([rng.randrange(50_257) for _ in range(30)],) for _ in range(200)] + [(None,), ([],)]
    for r in bpe.decoded(spark.createDataFrame(rows, "ids array<int>")).collect():
        assert r["text"] == (library.decode(r["ids"], skip_special_tokens=False) if r["ids"] else "")
