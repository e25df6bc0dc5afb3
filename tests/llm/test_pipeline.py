"""Each stage on its own input; the whole against the operators applied by hand."""

import corpus_pipeline
from millrace.llm import decontam, quality, simhash, toxicity
from tests.conftest import SMALL


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")

    def rows(kept):
        return spark.createDataFrame(docs[docs.doc_id.isin(kept)][["doc_id", "text", "lang"]])

    kept = {r["doc_id"] for r in toxicity.scored(rows(docs.doc_id), labels).filter("predicted = 0").collect()}
    kept = {r["doc_id"] for r in quality.judged(rows(kept)).collect() if r["kept"]}
    kept = {r["component_id"] for r in simhash.near_duplicates(rows(kept)).collect()}
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    kept = {r["doc_id"] for r in decontam.with_matches(rows(kept), items).collect() if not r["matches"]}
    got = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in got.collect()} == kept and got.count() == len(kept)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_stages_keep_columns_and_edges(spark):
    text = "the of and to in a is that it for on was " * 2
    body = " ".join(f"{w}{i} {text}" for i, w in enumerate(["one", "two", "three", "four"]))
    rows = [(1, body, "en", "s", 1), (1, body, "en", "s", 1), (2, body, "en", "s", 1), (None, body, "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 4]
    assert dict(corpus_pipeline.STAGES)["bpe"](spark, docs, SMALL).count() == 6


def test_near_dedup_keeps_a_row_of_each_component(spark):
    """An id with two texts, one of them that of a smaller id, and one with two texts of its own."""
    first, second, third, fourth = (" ".join(f"{w}{i * i}" for i in range(60)) for w in ("ab", "kq", "xz", "mo"))
    rows = [(1, first), (2, first), (2, second), (3, third), (3, fourth), (3, fourth)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SMALL).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, first), (2, second), (3, third), (3, fourth)])
