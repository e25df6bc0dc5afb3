"""Work that grows with the rows is done once a row, and results hold on inputs that small tables lack."""

import os
import re
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import boilerplate, extraction, lexicons, markdown, needles, rules
from millrace.operators import chunking, integrity, requirements, search, similarity, store
from millrace.plans import QUERIES
from millrace.plans.adapters import Views
from millrace.sources import partitions
from tests.conftest import SMALL


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sections_of_a_text_are_cut_once(spark):
    docs = spark.createDataFrame([("# A\n## Skills\n- Rust x\n",)], "t string").repartition(2)
    for made in (extraction.routed(F.col("t")), rules.section_map(F.col("t"))):
        assert planned(docs.select(made.alias("r"))).count(r"(?=^(?:#{1,3}") == 1


def test_only_whole_references_are_decoded():
    assert markdown.to_markdown("<title>a&&amp</title><p>&copy; &copy x &ampx; &nope; &#65; &#65</p>") == "a&&amp\n\n© &copy x &ampx; &nope; A &#65"
    assert markdown.to_markdown('<a href="/x?a=1&amp;b=2&c=3">y</a>') == "[y](/x?a=1&b=2&c=3)"


def test_a_report_cleans_each_page_once_a_pass(spark):
    df = QUERIES["batch_report"](spark, SMALL)
    assert planned(df).count("affirmative") <= 4  # a pattern of the cleaning; twice in each of two passes would be more


def test_patterns_need_their_words():
    assert needles.needs(r"(?i)\bGNC\b|guidance\s+(?:and\s+)?control") == ("or", "gnc", ("and", "guidance", "control"))
    assert needles.needs(r"(?is)x*[ab]+") is None and needles.needs(r"\p{L}+") is None
    held = lambda need, low: need in low if isinstance(need, str) else (all if need[0] == "and" else any)(held(x, low) for x in need[1:])
    patterns = [p for ps in lexicons.DOMAINS.values() for p in ps] + [t[1] for t in requirements.TRIGGERS] + list(extraction.IMPLIED.values()) + [p for ps in rules.TECHNOLOGIES.values() for p in ps]
    texts = ["GUIDANCE and Control", "ci/cd REST api", "Must have 5+ years of C++ or C#", "Bachelor's degree, PhD", "test system design review", "cross functional team leadership", "System  Verilog FPGA"]
    for p in patterns:
        for text in texts:
            if re.search(p, text, re.I):
                assert held(needles.needs(p), text.lower()), (p, text)


@pytest.mark.parametrize("made", [extraction.skills, extraction.stated_requirements, lexicons.domain, extraction.technologies])
def test_texts_without_a_patterns_words_are_not_searched(spark, made):
    docs = spark.createDataFrame([("Guidance and Control, Python",)], "t string")
    assert "contains" in planned(docs.repartition(2).select(made(F.col("t")).alias("r"))).lower()


def test_phrases_and_triggers_are_searched_only_where_they_may_stand(spark):
    docs = spark.createDataFrame([("Team leadership is required",)], "t string").repartition(2)
    for made in (lexicons.found_phrases(F.col("t"), ["leadership"]), requirements.classified(F.col("t"))):
        assert "contains" in planned(docs.select(made.alias("r"))).lower()


def test_pairs_that_cannot_be_alike_are_not_matched(monkeypatch):
    calls = []

    class Counted(SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(similarity, "SequenceMatcher", Counted)
    texts = ["Must have knowledge of red steel and Python.", "We sell red steel to many people.", "Strong communication skills and the ability to lead 9 people.", "must have knowledge of red steel and python"]
    assert similarity.distinct_texts(texts) == [texts[2], texts[0], texts[1]]
    assert not calls


def test_a_batch_is_cut_slice_by_slice():
    seen = []

    class Watched:
        def __init__(self, arr):
            self.arr = arr

        def __len__(self):
            return len(self.arr)

        def slice(self, i, n):
            seen.append(n)
            return self.arr.slice(i, n)

    rows = [[f"a {i}."] * (i % 3) for i in range(3 * chunking.SLICE + 5)] + [None]
    got = chunking._by_slices(lambda x: [" ".join(x or [])], Watched(pa.array(rows, pa.list_(pa.string()))))
    assert got.to_pylist() == [[" ".join(x or [])] for x in rows] and seen == [chunking.SLICE] * 4
    assert chunking._by_slices(lambda x: x, pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_boilerplate_is_searched_where_its_words_are_and_what_is_glued_goes_too(spark):
    docs = spark.createDataFrame([("SHnextare now; apply  now",), ("Rock & roll",)], "t string").repartition(2)
    df = docs.select("t", boilerplate.without_boilerplate(F.col("t")).alias("r"))
    assert "contains" in planned(df).lower()
    assert {x["t"]: x["r"] for x in df.collect()} == {"SHnextare now; apply  now": "SHare now; ", "Rock & roll": "Rock & roll"}


def test_assessments_are_dealt_to_parts_by_the_size_of_their_table(spark, monkeypatch):
    def found():
        return {name: sorted(map(str, QUERIES[name](spark, SMALL).collect())) for name in ("issue_files", "issue_report")}

    parts = lambda: re.findall(r"RepartitionByExpression \[l_orderkey#\d+L\], (\d+)", planned(Views(spark, SMALL).assessments))
    small = found()
    assert parts() == []
    size = os.path.getsize(f"{SMALL}/lineitem.parquet")
    for n in (50, 100):
        monkeypatch.setattr(partitions, "PART_BYTES", -(-size // n))
        assert [abs(int(x) - n) <= 1 for x in parts()] == [True]
    assert found() == small


def test_rows_are_repeated_in_one_pass(spark):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "id int, n int").repartition(2)
    assert sorted(x["id"] for x in store.repeated(df, F.col("n")).collect()) == [1, 1, 3]
    # of the three views of assessments, the first has each row twice without being made twice
    assert planned(QUERIES["issue_report"](spark, SMALL)).count("Aggregate [l_orderkey") == 3


def test_equal_texts_of_a_batch_are_searched_for_spans_once(monkeypatch):
    texts = ["Must have knowledge of red steel and Python.", None, "", "We sell steel.", "İf asked: ability to K.", "Not required, nice to have X."] * 50
    calls, search = [], requirements._phrases
    monkeypatch.setattr(requirements, "_phrases", lambda x: calls.append(x) or search(x))
    got = requirements.span_lists(pa.array(texts, pa.string())).to_pylist()
    assert len(calls) == 6
    assert got == [requirements.phrase_spans(x or "") for x in texts]
    assert requirements.span_lists(pa.array([], pa.string())).to_pylist() == [] and requirements.span_lists(pa.array([None, "x"])).to_pylist() == [[], []]
    # a capital dotted i folds to if: the condition counts
    assert [(x["trigger_word"], x["confidence"]) for x in got[4]] == [("ability to", 0.77)]


def test_sentences_are_dealt_to_parts_by_the_size_of_their_table(spark, monkeypatch):
    names = ("sections", "fuzzy_dedup")
    small = [sorted(map(str, QUERIES[name](spark, SMALL).collect())) for name in names]
    n = 40
    monkeypatch.setattr(partitions, "PART_BYTES", -(-os.path.getsize(f"{SMALL}/lineitem.parquet") // n))
    made = [QUERIES[name](spark, SMALL) for name in names]
    for df in made:
        assert [abs(int(x) - n) <= 1 for x in re.findall(r"RepartitionByExpression \[id#\d+L\], (\d+)", planned(df))] == [True]
    assert [sorted(map(str, df.collect())) for df in made] == small


def test_a_frequent_words_postings_are_dealt_to_more_tasks_the_more_write(spark, tmp_path, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("k"), F.lit("word").alias("t"))
    for tasks, least, most in ((0, 1, 8), (256, 9, 32)):
        path = str(tmp_path / str(tasks))
        search.write_index(docs, "k", ["t"], path, tasks)
        read = search.read_index(spark, path, "word")
        assert least <= len(read.inputFiles()) <= most and read.select("k").distinct().count() == 4000
    small = QUERIES["keyword_lookup"](spark, SMALL).collect()
    monkeypatch.setattr(partitions, "PART_BYTES", 1 << 13)
    assert partitions.parts_of(Views(spark, SMALL).table("lineitem")) > 8
    assert QUERIES["keyword_lookup"](spark, SMALL).collect() == small


def test_advice_asks_for_each_type_once(spark):
    found = spark.range(100).select(F.when(F.col("id") % 2 == 0, "invalid_score").otherwise("fts_orphan").alias("issue_type"))
    df = integrity.advised(found)
    assert re.search(r"Aggregate \[issue_type#\d+\]|Aggregate \[_groupingexpression#\d+\]", planned(df)), planned(df)
    assert [tuple(x) for x in df.collect()] == [("purge invalid scores", 2), ("rebuild index", 4)]


def test_ordered_issues_are_made_once_and_not_for_the_sorts_sample_too(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def kind(i):
        made.add(1)
        return ["b", "a"][i % 2]

    found = spark.range(100).select(kind("id").alias("issue_type"), F.lit("error").alias("severity"), F.lpad(F.col("id").cast("string"), 3, "0").alias("record_id"))
    got = [tuple(x) for x in integrity.ordered(found).collect()]
    assert got == sorted(got, key=lambda x: (x[0], x[2])) and len(got) == 100
    assert made.value == 100


def test_integrity_queries_make_assessments_once_a_check_and_deal_them(spark, monkeypatch):
    names = ("integrity_by_type", "integrity_issues", "integrity_advice", "integrity_report")
    small = [sorted(map(str, QUERIES[name](spark, SMALL).collect())) for name in names]
    assert planned(QUERIES["integrity_by_type"](spark, SMALL)).count("Aggregate [l_orderkey") <= 7  # a union of the rows with some of them makes twice as many
    monkeypatch.setattr(partitions, "PART_BYTES", 1 << 13)
    made = [QUERIES[name](spark, SMALL) for name in names]
    assert all("RepartitionByExpression [l_orderkey" in planned(df) for df in made)
    assert [sorted(map(str, df.collect())) for df in made] == small
