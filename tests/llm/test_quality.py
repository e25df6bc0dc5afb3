"""Quality rules against brute force; the base columns in full, the verdict by labels."""

import collections
import random
import re

from millrace.llm import quality, queries
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    counts = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(len(words) - 2):
        if counts[tuple(words[i : i + 3])] > 1:
            inside.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op2_quality"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r[n] for n in NAMES) == base(docs[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_verdicts_follow_labels(spark):
    from tests.llm.support import labelled

    got = labelled(spark, queries.QUERIES["op2_quality"](spark, "/root/testdata/sf0.01"), "quality").filter("NOT base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.15


def test_edges(spark):
    words = "the of and to in a is that it for on was be with as by " * 5
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "a b a b a b\n　\nx\nx", "xx", "x"), (4, words, "en", "x"), (4, words, "en", "x"), (5, "é à " * 30_000, "fr", "x"), (None, "#*", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    out = quality.judged(df)
    assert out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "boolean"
    got = sorted((tuple(r[n] for n in NAMES) for r in out.collect()), key=str)
    assert got == sorted((base(r[1]) for r in rows), key=str)
    assert quality.judged(df.limit(0)).count() == 0
    # a filter on a verdict ends, and gives what the column says
    assert out.filter("kept").count() == sum(r["kept"] for r in out.collect())


def test_languages_without_case_beside_cased_ones(spark):
    rng = random.Random(6)
    italian = " ".join("".join(rng.choice("abcdeilmnoprstuv") for _ in range(5)) for _ in range(120))
    made = {"it": italian}
    for lang, first in (("ar", 0x0628), ("hi", 0x0915), ("he", 0x05D0), (None, 0x0E01)):
        made[lang] = " ".join("".join(chr(first + rng.randrange(17)) for _ in range(5)) for _ in range(120))
    rows = [(n, text, lang) for n, (lang, text) in enumerate(made.items()) for _ in range(3)] + [(9, "#|$ %& " * 60 + italian[:200], "it")]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["class_distance"] is not None for r in got)
    assert all(r["kept"] and r["class_distance"] < 0.01 for r in got if r["doc_id"] < 9)
    assert not any(r["kept"] for r in got if r["doc_id"] == 9)
