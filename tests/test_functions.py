"""Columns against plain Python and small tables of cases."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import boilerplate, identity, lexicons, markdown, scalars, text
from millrace.operators import chunking, requirements, scoring, search, similarity


def value(spark, column, *rows, ddl="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)
    return [r[0] for r in df.select(column(F.col(df.columns[0])).alias("v")).collect()]




def test_canonical_url_and_portal(spark):
    urls = ["https://a.b/c;p?q#f", "https://boards.greenhouse.io/x/jobs/12345678", "https://a.b/1234567", "https://x/?gh_jid=9", "", None]
    assert value(spark, lambda x: identity.canonical_url(x), *urls)[:2] == ["https://a.b/c", "https://boards.greenhouse.io/x/jobs/12345678"]
    assert value(spark, lambda x: identity.portal_id(x), *urls) == [None, "12345678", None, "9", None, None]
    assert value(spark, lambda x: identity.portal(x), *urls) == ["custom", "greenhouse", "custom", "greenhouse", "custom", "custom"]


def test_job_id_is_the_hash_of_its_parts(spark):
    got = value(spark, lambda x: identity.job_id(F.lit("Über Co."), F.lit("Dev"), F.lit("Ort"), F.lit("https://a.b/c?q=1")), "r")[0]
    assert got == "custom:" + hashlib.sha256("überco|dev|ort|https://a.b/c".encode()).hexdigest()[:16]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .,\n\té", max_size=30), min_size=1, max_size=8))
def test_word_tokens_like_python(spark, texts):
    want = [0 if t == "" else max(1, int(len(t.split()) * 1.3)) for t in texts]
    assert value(spark, lambda x: scalars.word_tokens(x), *texts) == want


def test_boilerplate(spark):
    assert value(spark, lambda x: boilerplate.has_boilerplate(x), "Equal  opportunity", "plain", None) == [True, False, False]
    assert value(spark, lambda x: boilerplate.has_boilerplate(x, "nothing"), "Equal opportunity") == [False]
    assert value(spark, lambda x: boilerplate.without_boilerplate(x), "We believe in x.   Apply now") == [" in x. "]
    assert value(spark, lambda x: boilerplate.decoded(x), "a&lt;b&nbsp;&#8212;c&amp;") == ["a<b c&"]


def test_markdown_lines(spark):
    assert value(spark, lambda x: text.header_level(x), "# A", "### B", "**C**", "plain", "- **x**") == [1, 3, -1, -2, -2]
    assert value(spark, lambda x: text.bullets(x), "a\n- b\n  c\nd\n1. e") == [["b c", "e"]]
    assert value(spark, lambda x: text.sections(x), "x\n# A\ny\n**B**\nz", "") == [["x", "# A\ny", "**B**\nz"], []]
    assert value(spark, lambda x: text.bullets_plain(x), "- a\n2) b!\nc") == ["a.\nb!\nc"]
    assert value(spark, lambda x: text.sentences(x), "One e.g. two. Three!\nFour", None) == [["One e.g. two.", "Three!", "Four"], []]


def test_header_lines(spark):
    md = "Intro\nMust-Have:\n**Preferred Qualifications**\nx\n**Tools** include:\nGo\n**Last**\n# End\n\\*\\*Why\\*\\*\n\ny\n**Alone**\n\n**Then**\nz\nTeam:\n- a"
    want = "Intro\n## Must-Have\n## Preferred Qualifications\nx\n### Tools\nGo\n**Last**\n# End\n### Why\n\ny\n### Alone\n\n### Then\nz\nTeam:\n- a"
    assert value(spark, lambda x: text.bold_headers(text.keyword_headers(x)), md, None) == [want, ""]
    assert value(spark, lambda x: text.structured(x), "a\n**Skills**\nb\nTeam:\nc") == ["a\n\n---\n## Skills\nb\n\n---\n### Team\nc"]
    assert value(spark, lambda x: text.is_raw_html(x), "see <a href='x'>", "AT&amp;T", "a &lt;b", "a <br> b", "plain", "", None) == [True, True, True, False, False, True, True]
    assert value(spark, lambda x: boilerplate.has_boilerplate(x, "legal_compliance"), "equal opportunity") == [True]


def slow_bullets(md):
    out, item = [], None
    for line in md.split("\n"):
        if m := re.match(r"\s*(?:[*+•-]|\d+[.)])\s+", line):
            out += [item] if item is not None else []
            item = line[m.end() :].strip()
        elif not line.strip():
            continue
        elif item is not None and re.match(r"\s+\S", line):
            item += " " + line.strip()
        else:
            out += [item] if item is not None else []
            item = None
    return out + ([item] if item is not None else [])


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["- a", "  b c", "", "d", "* e  f", "1. g", "   h", "-x", "2) i"]), max_size=12), min_size=1, max_size=6))
def test_bullets_like_python(spark, cases):
    texts = ["\n".join(x) for x in cases]
    assert value(spark, lambda x: text.bullets(x), *texts) == [slow_bullets(x) for x in texts]


def test_chunks_are_cut_in_one_pass(spark):
    import time

    took = []
    for n in (2_000, 20_000):
        parts = [f"s{i} and some more words of it" for i in range(n)]
        df = spark.createDataFrame([(parts,)], "x array<string>").cache()
        df.count()
        began = time.time()
        got = df.select(chunking.chunked(F.col("x"), 100).alias("c")).first()["c"]
        took.append(time.time() - began)
        assert len(got) == -(-n // 14) and " ".join(got) == " ".join(parts)
    assert took[1] < 10 * took[0] + 1


def test_unknown_polish_rule(spark):
    with pytest.raises(ValueError):
        text.polished(F.lit(""), ["nope"])


def test_html_to_markdown():
    assert markdown.to_markdown("<h1>T</h1><p>a <b>b</b> &amp; c<ul><li>x<li>y</ul><script>s('</p>')</script>") == "# T\n\na **b** & c\n\n- x\n- y"
    assert markdown.to_markdown("<script></script>") == "<script></script>"


def test_plain_html(spark):
    assert value(spark, lambda x: text.plain(x), "<p>a</p><script>x</script><!-- c --><p>b &amp; c", None) == ["a\nb & c", ""]


def test_classified(spark):
    rows = ["Required: Java", "Java is not required", "nice to have Go", "plain", "must have x if y", None]
    got = value(spark, lambda x: requirements.classified(x), *rows)
    assert [None if g is None else (g["trigger"], g["confidence"]) for g in got] == [("required", 0.95), None, ("nice to have", 0.15), None, ("must", 0.78), None]


def test_phrase_spans():
    (got,) = requirements.phrase_spans("You need the ability to lead teams and ship code, if asked.")
    assert (got["trigger_word"], got["span_type"], got["conjunct_count"]) == ("ability to", "compound", 2)
    assert got["span_text"] == "ability to lead teams and ship code"
    assert requirements.phrase_spans("") == []


def test_chunks(spark):
    parts = ["a b c", "d e", "f", "g h i j k l"]
    assert value(spark, lambda x: chunking.chunked(x, 5), (parts,), ddl="x array<string>") == [["a b c d e", "f", "g h i j k l"]]
    assert value(spark, lambda x: chunking.chunked(x, 5), ([],), ddl="x array<string>") == [[]]


def test_lexicons(spark):
    assert value(spark, lambda x: lexicons.found_words(x, ["c++", "go", "sql"]), "Go, C++ and NoSQL.", None) == [["c++", "go"], []]
    assert value(spark, lambda x: lexicons.case_flips(x), "JavaScript", "abc") == [3, 0]
    assert value(spark, lambda x: lexicons.domain(x), "FPGA and Verilog", "hello", None) == ["hardware", "general", "general"]


@pytest.mark.parametrize(("query", "found"), [("a b", ["1"]), ("a OR z", ["1", "2"]), ("a NOT b", ["2"]), ('"b c"', ["1"]), ("b*", ["1", "3"]), ("CAFE", ["3"]), ("(a", []), ("", []), ("AND", []), ('"x', [])])
def test_search(spark, query, found):
    df = spark.createDataFrame([("1", "a b c"), ("2", "a c b2 x".replace("b2 ", "")), ("3", "bb café")], "job_id string, title string")
    assert sorted(r[0] for r in search.search(df, query, columns=("title",)).select("job_id").collect()) == found
    assert sorted(r[0] for r in search.indexed(df, search.index(df, "job_id", ["title"]), query).select("job_id").collect()) == found


def test_fuzzy_distinct():
    assert similarity.distinct_texts(["5 years of Java", "5+ yrs of Java", "Go"]) == ["5 years of Java", "Go"]
    assert similarity.likeness("A (b)", "a") == 1.0


def test_overlap(spark):
    rows = [(["A", "b"], ["a", "c"]), ([], []), (["x"], ["x"])]
    assert value(spark, lambda x: scoring.overlap(F.col("h"), F.col("w")), *rows, ddl="h array<string>, w array<string>") == [50.0, 100.0, 100.0]


def test_replies(spark):
    good = '```json\n{"overall_score": 1, "tech_score": 2, "seniority_score": 3, "location_score": 4}\n```'
    got = value(spark, lambda x: scalars.scoring_reply(x), good, '{"overall_score": 1}', "x", None)
    assert got[0]["tech_score"] == 2.0 and got[1:] == [None, None, None]


def test_dates(spark):
    got = value(spark, lambda x: scalars.minute(x), "2024-01-02T03:04:05Z", "not a moment at all", None)
    assert got == ["2024-01-02 03:04", "not a moment at ", "not processed"]
    assert re.fullmatch("█{10}░{10}", value(spark, lambda x: scalars.bar(F.lit(50)), "r")[0])


def test_budgeted_and_guarded_chunks(spark):
    assert value(spark, lambda x: chunking.budgeted(x, 4), "a b. c! d e f g h. i", None) == [["a b. c", "d e f g h", "i"], []]
    rows = (["a b c", "d e", "f g"], ["b c d"])
    df = spark.createDataFrame([rows], "s array<string>, p array<string>")
    assert df.select(chunking.guarded(F.col("s"), F.col("p"), 3).alias("c")).first()["c"] == ["a b c d e", "f g"]


def test_registry(spark):
    from millrace.functions import registry

    df = spark.createDataFrame([("**A**  b\n\n\n\nc",)], "x string")
    assert registry.applied(df, "x", ["emphasis", "space"], "y").first()["y"] == "A b\n\nc"
    with pytest.raises(ValueError):
        registry.applied(df, "x", ["nope"])
    with pytest.raises(ValueError):
        registry.register("plain", lambda c: c)
    registry.register_sql(spark)
    assert registry.execute(spark, "SELECT html_to_markdown(:h) AS m, text_likeness('a', 'A') AS l", h="<b>x</b>").first() == ("**x**", 1.0)


def test_watched(spark):
    import threading

    from millrace.functions import registry

    got, done = {}, threading.Event()
    df = registry.watched(spark.range(10), lambda m: (got.update(m), done.set()), n=F.count("*"), top=F.max("id"))
    assert df.count() == 10 and done.wait(20) and got == {"n": 10, "top": 9}


def test_bpe_tokens(spark, tmp_path):
    pytest.importorskip("tokenizers")
    import json

    vocab = {"a": 0, "b": 1, "ab": 2, "abab": 3}
    (tmp_path / "v.json").write_text(json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "BPE", "vocab": vocab, "merges": [["a", "b"], ["ab", "ab"]]}}))
    assert value(spark, lambda x: scalars.bpe_tokens(x, str(tmp_path / "v.json")), "abab ab", "aab", "", None) == [2, 2, 0, 0]


def test_search_or_like(spark):
    df = spark.createDataFrame([("1", 'a "quoted'), ("2", "b")], "job_id string, title string")
    assert [r[0] for r in search.search_or_like(df, '"quoted', columns=("title",)).select("job_id").collect()] == ["1"]
    assert value(spark, search.stemmed, "Running", "classes", "flies", "quickly", "us") == ["run", "class", "fli", "quick", "us"]
