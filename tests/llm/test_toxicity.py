"""The automaton against edit distance, and held-out accuracy of the score."""

import random
import zlib

from pyspark.sql import functions as F

from millrace.llm import queries, toxicity
from tests.llm.support import labelled


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_trie_walk_like_edit_distance():
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(4, 8))) for _ in range(30)}
    lexicon = toxicity.Lexicon([(f"w:{w}", 1.0) for w in words])
    for _ in range(5000):
        token = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 10)))
        near = len(token) >= 5 and any(len(w) >= 5 and distance(token, w) <= 1 for w in words)
        assert lexicon.kind(token)[0] == (1 if token in words else 2 if near else 0)


def test_stems_folding_and_context():
    lexicon = [("w:stupid", 5.0), ("s:lowe", 5.0)]
    scorer = toxicity.Scorer(lexicon)
    none = (0.0,) * toxicity.FEATURES
    assert scorer.features("") == none and scorer.features("all fine here") == none
    assert scorer.features("you are $tup1d!")[0] == 1.0 and scorer.features("stupit thing")[3] == 1.0 and scorer.features("loweichen")[0] == 1.0
    aimed, said = scorer.features("you are stupid")[1], scorer.features('he said "stupid" is a word')[1]
    assert aimed > said


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01")
    rows = labelled(spark, got, "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "stupid " * 20_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.scored(docs, labels)
    assert dict(out.dtypes)["score"] == "double" and out.count() == 4 and out.filter("held_out IS NULL OR score IS NULL").count() == 0
    assert toxicity.scored(docs.limit(0), labels.limit(0)).count() == 0
    assert out.filter(F.col("predicted") == 1).count() == 0


def test_rare_terms_are_learned_but_not_from_copies(spark):
    """Of 1,000 toxic documents 10 hold an insult, and 12 are copies of one text."""
    rows = [(i, f"you are a moron n{i}", 1) for i in range(978)] + [(i, f"such a gnorf n{i}", 1) for i in range(978, 988)]
    rows += [(i, "copied zibble", 1) for i in range(988, 1000)] + [(i, f"you are a friend and such n{i}", 0) for i in range(1000, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = {t for t, _ in toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True)).terms}
    assert {"w:moron", "w:gnorf"} <= terms and not any("zib" in t for t in terms)


def test_deletions_swaps_and_words_of_stems():
    scorer = toxicity.Scorer([("w:idiot", 1.0), ("w:trash", 1.0), ("w:moron", 1.0), ("w:scum", 1.0), ("w:stupid", 1.0), ("s:lose", 1.0), ("n:losers", 1.0)])
    for token in ("idot", "trsh", "mron", "scm", "skum", "scumm", "csum", "idoit", "stupdi", "stpd", "stuupiid", "lsoers", "oosers", "kosers"):
        assert scorer.lexicon.kind(token)[0] == 2, token
    for token in ("idea", "sum1", "crash2", "tidy", "the", "students", "roses7"):
        assert scorer.lexicon.kind(token)[0] == 0, token


def test_misspellings_like_edit_distance():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(12)}
    lexicon = toxicity.Lexicon([(f"w:{w}", 1.0) for w in words], toxicity.misspelt)
    for _ in range(3000):
        token = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 11)))
        swapped = {token[:i] + token[i + 1] + token[i] + token[i + 2 :] for i in range(len(token) - 1)}
        near = any((most := toxicity.misspelt(w)) and (distance(token, w) <= most or w in swapped) for w in words)
        assert lexicon.kind(token)[0] == (1 if token in words else 2 if near else 0)


def test_words_of_a_stem_are_kept_for_misspellings():
    counts = {"s:lose": 40, "w:loser": 20, "w:losers": 20}
    assert {t for t, _ in toxicity._chosen(counts, {}, 100, 1000)} == {"s:lose", "n:loser", "n:losers"}
