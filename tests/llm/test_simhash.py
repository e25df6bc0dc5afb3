"""Fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash

from millrace.llm import queries, simhash
from tests.conftest import SMALL


def slow_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    prints = np.array(prints, np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(prints))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 700).astype(np.uint64)
    b = a[:600].copy()
    for i in range(len(b)):
        for k in rng.integers(0, 64, rng.integers(0, 10)):
            b[i] ^= np.uint64(1) << np.uint64(k)
    i, j = simhash.near(a, b, radius)
    want = np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().sort_values("doc_id")
    got = queries.QUERIES["op1_simhash"](spark, SMALL).toPandas().sort_values("doc_id")
    prints = [slow_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == docs.doc_id.to_numpy()[slow_components(prints)].tolist()


@pytest.mark.parametrize(("block", "split"), [(8, 4096), (8, 16), (4096, 32)])
def test_large_buckets_lose_no_link(spark, block, split):
    """A ball of near fingerprints, in one bucket of each band, over blocks and over bands of the remaining bits."""
    rng = np.random.default_rng(0)
    ball = {0}
    for _ in range(150):
        ball.add(sum(1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 7))))
    prints = sorted(ball) + [int(x) for x in rng.integers(0, 2**62, 40)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.links(df, 4, block, split)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    label = slow_components(prints)
    for i, p in enumerate(prints):
        assert roots.get(p, p) == prints[label[i]]


def test_long_chain(spark):
    """Components reach over many links."""
    prints = [((1 << (3 * i)) - 1) for i in range(20)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["root"] for r in simhash.components(simhash.links(df)).collect()}
    assert roots == {0}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(3, None, "x"), (2, "", "x"), (2, "", "x"), (None, "one two", "x"), (5, "ONE\ttwo", "x"), (None, "lonely words here now and then", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"] if r["component_id"] is not None else -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 5), (2, 2), (2, 2), (3, 2), (5, 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_text():
    text = " ".join(f"w{i % 977}" for i in range(80_000))
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
