"""Whole queries against brute force over all rows of the small tables: scores by trying every word, passages by every item
against every text, the pipeline by plain versions of its stages."""

import math

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import decontam, queries, toxicity
from millrace.llm.oracles import ORACLES
from tests.conftest import SMALL
from tests.llm.test_decontam import distance
from tests.llm.test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}


def words(text):
    return [decontam.plain(c) for c in text.lower().split()]


def swapped(a, b):
    return len(a) == len(b) and any(b[:i] + b[i + 1] + b[i] + b[i + 2 :] == a for i in range(len(b) - 1))


def slow_kinds(terms, tokens):
    """Kind and weight of each token, by trying every term."""
    out = {}
    for token in tokens:
        exact = max([w for t, w in terms if (t[0] == "s" and token.startswith(t[2:])) or (t[0] == "w" and token == t[2:])], default=0.0)
        near = [] if exact else [w for t, w in terms if t[0] in "wn" and (k := toxicity.misspelt(t[2:])) and abs(len(token) - len(t[2:])) <= k and (swapped(token, t[2:]) or distance(token, t[2:]) <= k)]
        out[token] = (1, exact) if exact else (2, max(near)) if near else (0, 0.0)
    return out


def slow_scores(model, texts):
    """Scores with every chunk's kind from trying every term, and its window looked at by itself."""
    chunks = {c for t in texts for c in t.lower().split()}
    kinds = slow_kinds(model.terms, {toxicity.folded(c) for c in chunks})
    out = []
    for t in texts:
        parts = t.lower().split()
        hits = [(i, *kinds[toxicity.folded(c)]) for i, c in enumerate(parts) if kinds[toxicity.folded(c)][0]]
        aim = {k: [toxicity.Scorer._abuse(parts, i) for i, kind, _ in hits if kind == k] for k in (1, 2)}
        exact, odds = sum(k == 1 for _, k, _ in hits), list({parts[i]: w for i, k, w in hits if k == 1}.values())
        row = [float(exact > 0), math.log1p(sum(aim[1])), math.log1p(len(aim[1]) - sum(aim[1])), float(bool(aim[2]) and (sum(aim[2]) > 0)), math.log1p(sum(aim[2])), math.log1p(len(aim[2]) - sum(aim[2])), min(5.0, 100.0 * exact / max(1, len(parts))), max(odds, default=0.0), math.log1p(sum(odds))]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], row, strict=True))
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


def learned(spark, table, labels):
    return toxicity.learn(table, labels, ~toxicity.held_out(F.col("id")))


def test_toxicity(spark, docs):
    model = learned(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert model.terms
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op3_toxicity"](spark, SMALL).collect()}
    want = dict(zip(docs, slow_scores(model, [r["text"] for r in docs.values()]), strict=True))
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in got)


def passages(text, items):
    """Items that some part of a text comes near enough to."""
    body = words(text)
    return {i for i, item in items.items() if item and decontam.closest(item, body)[0] <= int(0.2 * len(item) + 1e-9)}


def test_passages(spark, docs, items):
    got: dict = {}
    for r in queries.QUERIES["op4_decontaminate"](spark, SMALL).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    want = {d: x for d, r in docs.items() if (x := passages(r["text"], items))}
    assert want and all(got.get(d, set()) <= x for d, x in want.items()) and not got.keys() - want.keys()
    pairs = sum(map(len, want.values()))
    assert sum(len(got.get(d, set())) for d in want) >= 0.99 * pairs


def test_pipeline(spark, docs, items):
    """Each stage's rule by brute force on what the stages before it kept."""
    table, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = slow_scores(learned(spark, table, labels), [r["text"] for r in docs.values()])
    left = {i: r for (i, r), s in zip(docs.items(), scores, strict=True) if s < 0.5}
    con = duckdb.connect()
    frame = spark.createDataFrame(list(left.values()), table.schema).toPandas()  # noqa: F841 - read by name
    con.execute("CREATE TABLE documents AS SELECT * FROM frame")
    left = {i: left[i] for i, kept in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op2_quality']})").fetchall() if kept}
    ids = sorted(left)
    label = slow_components([slow_fingerprint(left[i]["text"]) for i in ids])
    left = {ids[k]: left[ids[k]] for k in sorted(set(label.tolist()))}
    left = {i: r for i, r in left.items() if not passages(r["text"], items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, r in left.items():
        found = library.encode(r["text"], add_special_tokens=False).ids
        want[i] = (len(found), found, library.decode(found, skip_special_tokens=False))
    got = {r["doc_id"]: (r["n_tokens"], list(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and len(want) > 20


def test_items_side_by_side():
    """Each of two occurrences that touch is found, also of an item that repeats itself."""
    item = "a b a b a b a b a b"
    (hits,) = decontam.Matcher([item]).texts([f"x {item} {item} y"])
    assert [(h.start, h.end) for h in hits if h.distance == 0] == [(1, 11), (11, 21)]
