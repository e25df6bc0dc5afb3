"""Token counts and BPE ids against the library, on random texts and edge cases."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, queries, token_count
from tests.conftest import SMALL

ALPHABET = "ab cde'st  \n\t 　éßΩЖ漢字123!!..,<|endoftext|>\x1c\x85 re ll'ReΣİÅé"


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(800)]
    return [*out, "", " ", "   ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "ab" * 3000, "a" * 800, "x\n \n y", "hello'll"]


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_like_the_library(byte_level):
    rows = texts()
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        counter = token_count.Counter(f.read(), cache=500)
    got = [n for i in range(0, len(rows), 100) for n in counter.count(rows[i : i + 100])]
    assert got == [len(e.ids) for e in byte_level.encode_batch(rows, add_special_tokens=False)]


def test_ids_like_the_library(word_level):
    rows = texts()
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        codec = bpe.Codec(f.read(), cache=500)
    ids = codec.encode(rows)
    want = word_level.encode_batch(rows, add_special_tokens=False)
    assert ids.to_pylist() == [e.ids for e in want]
    assert codec.decode(ids).to_pylist() == [word_level.decode(e.ids, skip_special_tokens=False) for e in want]


def test_one_tree_and_many_agree():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        codec = bpe.Codec(f.read())
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("abcdehilnorst") for _ in range(rng.randrange(1, 60))).encode()
        (many,) = bpe.encode_words(codec.vocab, [word])
        flat, _ = codec.vocab.symbols([word])
        assert bpe._one(codec.vocab, flat.tolist()).tolist() == many.tolist()


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 7), (1, "a b", 8), (1, "a b", 8), (None, "", 9)], "doc_id long, text string, n_tokens int")
    got = token_count.with_token_counts(df)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == [(0, 0, False), (0, 0, False), (3, 2, False), (3, 2, False)]
    clash = df.withColumnRenamed("n_tokens", "ids").withColumn("decoded", F.lit("x"))
    got = bpe.with_round_trip(clash)
    assert got.columns == ["doc_id", "text", "ids", "decoded"] and sorted(map(len, (r["ids"] for r in got.collect()))) == [0, 0, 2, 2]
    assert token_count.with_token_counts(df.limit(0)).count() == 0 and bpe.with_round_trip(df.limit(0)).count() == 0
    assert [r["d"] for r in df.select(bpe.decode(bpe.encode(F.col("text"))).alias("d")).collect()] == ["", "a</w> b</w>", "a</w> b</w>", ""]


def test_queries(spark, byte_level, word_level):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_token_counts"](spark, SMALL).collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len(docs[r["doc_id"]].encode()), len(byte_level.encode(docs[r["doc_id"]], add_special_tokens=False).ids))
    import hashlib

    for r in queries.QUERIES["op10_bpe"](spark, SMALL).collect():
        ids = word_level.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(word_level.decode(ids, skip_special_tokens=False)))
