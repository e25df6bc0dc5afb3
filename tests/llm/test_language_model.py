"""Base scores against brute force; the tree against its definition; held-out gain."""

import collections
import math
import zlib

import numpy as np

from millrace.llm import queries, suffix_lm

SF = "/root/testdata/sf0.01"


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lists = {i: suffix_lm.tokens(t.encode()) for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = collections.Counter(w for i, ws in lists.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = queries.QUERIES["op8_suffix_lm"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = lists[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(w in counts for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.5 * sum(r["n_tokens"] for r in out)


class BruteTree:
    """The tree by its definition, in dictionaries."""

    def __init__(self, texts):
        self.n = collections.Counter()
        for ws in map(suffix_lm.tokens, texts):
            for k in range(1, suffix_lm.DEPTH + 2):
                self.n.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        words = {g: c for g, c in self.n.items() if len(g) == 1}
        self.total, self.distinct = sum(words.values()), len(words)
        once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.kept = set()
        for g, c in self.n.items():
            if len(g) > 1 and c >= suffix_lm.LEAST:
                whole = self.n[g[1:-1]] if len(g) > 2 else self.total
                if c * abs(math.log(c * whole / (self.n[g[:-1]] * self.n[g[1:]]))) >= suffix_lm.GAIN:
                    self.kept.update(g[j:-1] for j in range(len(g) - 1))
        self.lone = collections.Counter()
        for g, c in self.n.items():
            if len(g) > 2 and self.n[g[-2:]] == 1:
                self.lone[g[:-1]] += c

    def p(self, context, w):
        while context and context not in self.kept:
            context = context[1:]
        if not context:
            c = self.n[(w,)]
            return (c - self.discount) / self.total if c else self.discount * self.distinct / self.total if self.total else 1.0
        mass = suffix_lm.MASS[len(context) - 1]
        n = self.n[(*context, w)] if len(context) == 1 or self.n[(context[-1], w)] > 1 else 0
        return (n + (mass + self.lone[context]) * self.p(context[1:], w)) / (self.n[context] + mass)

    def score(self, text):
        ws = suffix_lm.tokens(text)
        return sum(math.log10(self.p(tuple(ws[max(0, i - suffix_lm.DEPTH) : i]), w)) for i, w in enumerate(ws))


def texts_of(rows):
    return [(r["text"] or "").encode() for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]


def test_scores_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    tree = BruteTree(texts_of(rows))
    assert {len(c) for c in tree.kept} == {1, 2, 3}
    got = suffix_lm.scored(spark.createDataFrame(rows).repartition(5), chunk=5_000).collect()
    want = {r["doc_id"]: tree.score((r["text"] or "").encode()) for r in rows}
    assert len(got) == len(rows) and all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in got)


def test_small_texts_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(list("abcde"), rng.integers(0, 12)).tolist())) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree = BruteTree(texts_of(df.collect()))
    want = {i: tree.score(t.encode()) for i, t in rows}
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in suffix_lm.scored(df.repartition(3), chunk=100).collect())


def test_contexts_are_proper_distributions():
    texts = [b"a b c d", b"a b c e", b"x a b c d", b"a b d"] * 30 + [b"b a", b"c c c"] * 10
    tree = BruteTree(texts)
    assert tree.kept
    words = [g[0] for g in tree.n if len(g) == 1]
    for context in [(), *tree.kept]:
        assert math.isclose(sum(tree.p(context, w) for w in [*words, b"unknown"]), 1.0, rel_tol=1e-9)


def test_texts_seen_twice_stand_apart(spark):
    """A run of rare words that two training documents share is foreseen, one that stands once is not."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    words = [f"w{k}" for k in range(4000)]
    rows = [(i, " ".join(words[(j // 2 if j < 40 else j) * 40 :][:40])) for j, i in enumerate(ids)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in suffix_lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in ids[:40]) > max(got[i] for i in ids[40:]) + 0.5


def test_blobs():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (np.cumsum(suffix_lm.unpacked(suffix_lm.packed(suffix_lm.gaps(keys)), len(keys)), dtype=np.uint64) == keys).all()
    assert len(suffix_lm.unpacked(b"", 0)) == 0
    found, place = suffix_lm.distinct(keys[rng.integers(0, len(keys), 5000)])
    assert (np.sort(found) == found).all() and place.max() == len(found) - 1


def test_edges(spark):
    rows = [(0, "a b"), (0, "a b"), (2, None), (3, ""), (None, "a z"), (5, "long " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = suffix_lm.scored(df)
    assert sorted(r["n_tokens"] for r in got.collect()) == [1, 1, 3, 3, 3, 50_001]
    assert got.filter("score > 1e-9 OR score IS NULL OR base_score IS NULL").count() == 0
    assert suffix_lm.scored(df.limit(0)).count() == 0
    held = df.filter("doc_id = 0").withColumn("doc_id", df["doc_id"] + 0)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    only = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    assert {(r["n_known"], r["train_tokens"], r["score"]) for r in suffix_lm.scored(only).collect()} == {(0, 0, 0.0)} and held.count() == 2


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(600).cache()
    one, *more = ({r["doc_id"]: r["score"] for r in suffix_lm.scored(docs.repartition(k, "doc_id")).collect()} for k in (1, 4, 64))
    for other in more:
        assert one.keys() == other.keys() and all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("millrace_")]
