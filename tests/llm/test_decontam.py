"""Passages against brute force: exact ones, edited ones, and none elsewhere."""

import random

from millrace.llm import decontam, queries
from tests.conftest import SMALL


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_closest():
    rng = random.Random(1)
    for _ in range(1500):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(-1, 4) for _ in range(rng.randrange(0, 20))]
        best = min(distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        d, a, b = decontam.closest(item, text)
        assert d == best == distance(item, text[a:b])


def test_recall_of_edited_passages():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    matcher = decontam.Matcher(items)
    found = clean = 0
    for _ in range(400):
        i = rng.randrange(len(items))
        words = items[i].split()
        for _ in range(rng.randrange(matcher.edits(len(words)) + 1)):
            k = rng.randrange(len(words))
            match rng.randrange(3):
                case 0:
                    words[k] = "other"
                case 1:
                    words.pop(k)
                case _:
                    words.insert(k, rng.choice(vocabulary))
        around = [rng.choice(vocabulary) for _ in range(80)]
        (hits,) = matcher.texts([" ".join([*around[:40], *words, *around[40:]])])
        found += any(h.item == i for h in hits)
        (none,) = matcher.texts([" ".join(around)])
        clean += not none
    assert found >= 398 and clean >= 398


def test_query(spark):
    plain = lambda t: [decontam.plain(c) for c in t.lower().split()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = queries.QUERIES["op4_decontaminate"](spark, SMALL).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    for d, text in docs.items():
        line = f" {' '.join(plain(text))} "
        for i, words in items.items():
            if f" {' '.join(words)} " in line:
                assert (d, i) in pairs
    for r in got:
        span = plain(docs[r["doc_id"]][r["start"] : r["end"]])
        assert len(span) == r["words"] and distance(items[r["item_id"]], span) == r["distance"] <= 0.2 * len(items[r["item_id"]])


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, f"zero {item.upper()}! end {item}", "x"), (2, f"x {item}", "x"), (3, "é " * 30_000 + item, "x")], "doc_id long, text string, matches string")
    items = spark.createDataFrame([(7, item), (None, item), (8, None), (9, ""), (10, "zero")], "item_id long, text string")
    got = sorted((r["doc_id"], sorted((m["item_id"] or -1, m["start"], m["end"]) for m in r["matches"])) for r in decontam.with_matches(docs, items).collect())
    n = len(item)
    assert got[0] == (1, []) and got[1] == (1, [])
    assert (2, [(-1, 5, 5 + n + 1), (-1, n + 11, 2 * n + 11), (7, 5, 5 + n + 1), (7, n + 11, 2 * n + 11), (10, 0, 4)]) in got
    assert (3, [(-1, 60_000, 60_000 + n), (7, 60_000, 60_000 + n)]) in got
    assert decontam.with_matches(docs.limit(0), items.limit(0)).count() == 0


def test_recall_at_the_ends_of_texts():
    """Items with as many words left out as may be, or edited, as whole texts and at either end of one."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    matcher = decontam.Matcher(items)
    found, tried = [0, 0, 0], 150
    around = [f"v{i}" for i in range(40)]
    for _ in range(tried):
        i = rng.randrange(len(items))
        words = items[i].split()
        most = matcher.edits(len(words))
        match rng.randrange(3):
            case 0:
                words = words[most:]
            case 1:
                words = words[: len(words) - most]
            case _:
                for _ in range(most):
                    words.pop(rng.randrange(len(words)))
        for k, text in enumerate((words, [*words, *around], [*around, *words])):
            before, hits, after = matcher.texts([" ".join(around), " ".join(text), " ".join(around)])
            found[k] += any(h.item == i for h in hits)
            assert not before and not after
    assert min(found) >= 0.98 * tried, found


def test_windows_do_not_join_texts():
    item = "one two three four five six seven eight nine ten"
    words = item.split()
    assert decontam.Matcher([item]).texts([" ".join(words[:5]), " ".join(words[5:]), item]) == [[], [], [decontam.Hit(0, 0, 10, 0)]]


def test_recall_of_long_items_at_full_tolerance():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    for length in (59, 100, 200, 300, 500):
        for kind in range(3):
            found = 0
            for _ in range(20):
                item = [rng.choice(vocabulary) for _ in range(length)]
                matcher, words = decontam.Matcher([" ".join(item)]), item.copy()
                for k in sorted(rng.sample(range(length), matcher.edits(length)), reverse=True):
                    words[k : k + 1] = (["other"], [], [words[k], rng.choice(vocabulary)])[kind]
                around = [rng.choice(vocabulary) for _ in range(80)]
                (hits,) = matcher.texts([" ".join([*around[:40], *words, *around[40:]])])
                found += len(hits) == 1
            assert found >= 19, (length, kind, found)


def test_long_items_side_by_side():
    item = [f"w{i}" for i in range(150)]
    (hits,) = decontam.Matcher([" ".join(item)]).texts([" ".join(["x", *item, *item, "y", *item])])
    assert [(h.start, h.end, h.distance) for h in hits] == [(1, 151, 0), (151, 301, 0), (302, 452, 0)]
