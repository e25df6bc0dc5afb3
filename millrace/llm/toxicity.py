"""Toxicity by a lexicon trie walked with Levenshtein automata, and scores of the context around each hit.

A lexicon of words and stems is learned from labelled documents (terms that stand in many toxic documents and hardly
any other), put into a trie, and every token of a text is matched with it: exactly, or by intersecting the token's
Levenshtein automaton with the trie, which visits only prefixes that can still come within the allowed distance; the
automata of a batch of tokens walk the trie together. Each
hit is weighed by its window: quotation marks, reporting words and negation make it a mention, words of address make it
abuse. A logistic regression over these sums gives the score.

What is learned comes from a bounded sample of labelled rows (``sample``, taken by a hash of the id); lexicon and
weights go to the driver, whose size the sample bounds. All documents are scored.

Defined results: null and empty texts get the score of a text without hits; a document without a doc_id is scored and
counts as not held out; a document labelled twice counts twice in learning weights, and equal texts of a label once in learning terms; without any labelled rows the lexicon is
empty and every score is the same; repeated rows are scored alike; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.llm.common import bounded_batches, bucket_of, byte_slices, released, stored

#: About so many labelled rows are learned from.
SAMPLE = 40_000
#: A term must stand in so many toxic documents of different texts, and in so many times more of these than of others (as shares).
MIN_TOXIC, MIN_LIFT, MIN_PRECISION = 8, 8.0, 0.8
#: Terms in the lexicon at most.
TERMS = 2000
STEMS = (4, 5, 6, 7)
#: Tokens that walk the trie together.
BATCH = 20_000
WINDOW = 5
FEATURES = 9

#: Characters written for letters, words of address, words that report or deny.
WRITTEN_FOR = {"@": "a", "4": "a", "$": "s", "5": "s", "0": "o", "1": "i", "!": "i", "3": "e", "7": "t"}
ADDRESS = {"you", "your", "you're", "u", "du", "dein", "ihr", "sie", "tu", "ton", "ta", "vous", "votre", "usted", "eres", "vosotros", "te"}
REPORT = {"said", "says", "called", "quoted", "quote", "wrote", "word", "term", "not", "never", "nicht", "sagte", "wort", "mot", "dit", "pas", "dijo", "palabra", "no"}
QUOTES = "\"'“”‘’«»„`"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_FOLD = str.maketrans(WRITTEN_FOR)


def folded(chunk: str) -> str:
    """A lower-case chunk between spaces without the marks at its edges, with letters for the characters written for them."""
    if chunk.isalpha():
        return chunk
    bare = _EDGE.sub("", chunk)
    if bare.isalpha() or bare.isdigit():
        return bare
    return _EDGE.sub("", chunk.rstrip("!?.,;:").translate(_FOLD))


class Automata:
    """Levenshtein automata of many tokens of up to 31 characters, as bits: bit i of row d of a token is set if d edits bring
    what was read to the token's first i characters."""

    def __init__(self, tokens: list[str], most: int):
        self.most = most
        lengths = np.fromiter(map(len, tokens), np.uint32, len(tokens))
        self.lengths, self.end = lengths, np.uint32(1) << lengths
        self.inside = (self.end << np.uint32(1)) - np.uint32(1)
        self.codes = np.array(tokens, "U32").view(np.uint32).reshape(len(tokens), 32)
        self._places: dict[str, np.ndarray] = {}

    def start(self) -> list[np.ndarray]:
        return [np.uint32((2 << d) - 1) & self.inside for d in range(self.most + 1)]

    def places(self, char: str) -> np.ndarray:
        """Bits of the places of a character in each token."""
        if char not in self._places:
            self._places[char] = np.packbits(self.codes == np.uint32(ord(char)), axis=1, bitorder="little").view(np.uint32).reshape(-1)
        return self._places[char]

    def step(self, which: np.ndarray, state: list[np.ndarray], char: str) -> list[np.ndarray]:
        """State of the tokens ``which`` after one more character."""
        places, inside, one = self.places(char)[which], self.inside[which], np.uint32(1)
        low = (state[0] & places) << one
        rows = [low]
        for d in range(1, self.most + 1):
            low = ((state[d] & places) << one | state[d - 1] | state[d - 1] << one | low << one) & inside
            rows.append(low)
        return rows

    def swapped(self, which: np.ndarray, word: str) -> np.ndarray:
        """Which of the tokens become ``word`` when two neighbouring letters change places."""
        which = which[self.lengths[which] == len(word)]
        if len(word) < 2 or not len(which):
            return which[:0]
        codes, own = self.codes[which, : len(word)], np.array([word], f"U{len(word)}").view(np.uint32)
        unlike = codes != own
        first = unlike.argmax(1)
        row, last = np.arange(len(which)), len(word) - 1
        second = np.minimum(first + 1, last)
        good = (unlike.sum(1) == 2) & unlike[row, second] & (codes[row, first] == own[second]) & (codes[row, second] == own[first])
        # equal letters side by side may change places as well
        return which[good | ~unlike.any(1) & bool((own[1:] == own[:-1]).any())]


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    word: float = 0.0
    stem: float = 0.0
    edits: int = 0
    text: str = ""
    shortest: int = 0
    longest: int = 0


def misspelt(word: str) -> int:
    """Edits in which a misspelling of a word may differ from it; two letters that changed places always count as one."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


class Lexicon:
    """Words ("w:..."), stems ("s:...") and words that a stem covers ("n:...") in a trie, with their log odds. Misspellings are
    looked for among words of both kinds: within ``edits`` of a word, or with two neighbouring letters swapped; without
    ``edits``, one edit between words and tokens of five letters or more."""

    def __init__(self, terms: Iterable[tuple[str, float]], edits: Callable[[str], int] | None = None):
        self.root, self.near_root = Node(), Node()
        self.swaps, self.least = edits is not None, 0 if edits else 5
        edits = edits or (lambda word: int(len(word) >= 5))
        self.most = self.longest = 0
        for term, weight in terms:
            kind, text = term[0], term[2:]
            if kind == "s":
                self._put(self.root, text).stem = weight
                continue
            if kind == "w":
                self._put(self.root, text).word = weight
            if most := edits(text):
                node = self._put(self.near_root, text)
                node.word, node.edits, node.text = weight, most, text
                # two letters that changed places are two edits
                self.most, self.longest = max(self.most, most, 2 * self.swaps), max(self.longest, len(text) + most)
        self.shortest = self._measured(self.near_root, 0)

    @staticmethod
    def _put(node: Node, text: str) -> Node:
        for char in text:
            node = node.children.setdefault(char, Node())
        return node

    def _measured(self, node: Node, depth: int) -> int:
        """Sets the lengths of the shortest and longest words through each node."""
        for child in node.children.values():
            self._measured(child, depth + 1)
        below = [*([depth] if node.word else []), *(n for x in node.children.values() for n in (x.shortest, x.longest))]
        node.shortest, node.longest = min(below, default=0), max(below, default=0)
        return node.shortest

    def kind(self, token: str) -> tuple[int, float]:
        return self.kinds([token])[0]

    def kinds(self, tokens: list[str]) -> list[tuple[int, float]]:
        """Of each token (1, weight): in the lexicon; (2, weight): a misspelling of a term; (0, 0): neither."""
        out = [(1, found) if (found := self._exact(token)) else (0, 0.0) for token in tokens]
        if self.most:
            low, high = max(self.least, self.shortest - self.most), min(31, self.longest)
            at = [i for i, token in enumerate(tokens) if low <= len(token) <= high and not out[i][0]]
            for start in range(0, len(at), BATCH):
                part = at[start : start + BATCH]
                weights = self._near(Automata([tokens[i] for i in part], self.most))
                for k in np.flatnonzero(weights).tolist():
                    out[part[k]] = (2, float(weights[k]))
        return out

    def _exact(self, token: str) -> float:
        node, best = self.root, 0.0
        for char in token:
            node = node.children.get(char)  # type: ignore[assignment]
            if node is None:
                return best
            best = max(best, node.stem)
        return max(best, node.word)

    def _near(self, auto: Automata) -> np.ndarray:
        """For each token the weight of the best word that it may be a misspelling of: the trie is walked once for all of
        them, and each goes along only where its automaton can still accept."""
        best = np.zeros(len(auto.lengths))
        lengths = auto.lengths.astype(np.int64)
        stack = [(self.near_root, np.arange(len(lengths)), auto.start())]
        while stack:
            node, which, state = stack.pop()
            if node.word:
                end = auto.end[which]
                hit = which[(state[node.edits] & end) > 0]
                best[hit] = np.maximum(best[hit], node.word)
                if self.swaps and node.edits < 2:
                    hit = auto.swapped(which[(state[2] & end) > 0], node.text)
                    best[hit] = np.maximum(best[hit], node.word)
            for char, child in node.children.items():
                after = auto.step(which, state, char)
                alive = after[-1] != 0
                if child.shortest or child.longest:
                    alive &= (lengths[which] >= child.shortest - self.most) & (lengths[which] <= child.longest + self.most)
                if alive.any():
                    stack.append((child, which[alive], [x[alive] for x in after]))
        return best


class Scorer:
    """Features of texts under a lexicon; keeps the kind of each chunk it has met."""

    def __init__(self, terms: Iterable[tuple[str, float]], cache: int = 100_000):
        self.lexicon = Lexicon(terms, misspelt)
        self.cache = cache
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, float]] = {}

    def features(self, text: str) -> tuple[float, ...]:
        return self.rows([text])[0]

    def rows(self, texts: list[str]) -> list[tuple[float, ...]]:
        """Features of each text; the tokens that are new in any of them are looked up together."""
        lists = [text.lower().split() for text in texts]
        new = list(set().union(*lists) - self.seen)
        for chunk, kind in zip(new, self.lexicon.kinds([folded(x) for x in new]), strict=True):
            if kind[0]:
                self.hits[chunk] = kind
        self.seen.update(new)
        out = [self._features(chunks) for chunks in lists]
        if len(self.seen) > self.cache:
            self.seen = set(self.hits)
        return out

    def _features(self, chunks: list[str]) -> tuple[float, ...]:
        """(any exact, log exact abuse, log exact mentions, any near, log near abuse, log near mentions, exact per 100 words, largest and log sum of the weights of distinct hits)."""
        distinct = set(chunks)
        if self.hits.keys().isdisjoint(distinct):
            return (0.0,) * FEATURES
        sums = {1: [0.0, 0.0], 2: [0.0, 0.0]}
        exact = 0
        odds = [self.hits[c][1] for c in distinct if c in self.hits and self.hits[c][0] == 1]
        for i, chunk in enumerate(chunks):
            if chunk in self.hits:
                kind = self.hits[chunk][0]
                weight = self._abuse(chunks, i)
                sums[kind][0] += weight
                sums[kind][1] += 1 - weight
                exact += kind == 1
        return (float(exact > 0), math.log1p(sums[1][0]), math.log1p(sums[1][1]), float(sum(sums[2]) > 0), math.log1p(sums[2][0]), math.log1p(sums[2][1]), min(5.0, 100.0 * exact / len(chunks)), max(odds, default=0.0), math.log1p(math.fsum(odds)))

    @staticmethod
    def _abuse(chunks: list[str], i: int) -> float:
        """1: aimed at somebody; 0: a quotation or mention; a plain use stands between."""
        near = chunks[max(0, i - WINDOW) : i] + chunks[i + 1 : i + 1 + WINDOW]
        words = {folded(x) for x in near}
        weight = 0.7
        before, after = "".join(chunks[max(0, i - WINDOW) : i]), "".join(chunks[i + 1 : i + 1 + WINDOW])
        own = chunks[i]
        opened = own[0] in QUOTES or sum(before.count(q) for q in QUOTES) % 2 == 1
        closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any(q in after for q in QUOTES)
        if opened and closed:
            weight -= 0.5
        if words & REPORT:
            weight -= 0.2
        if words & ADDRESS:
            weight += 0.3
        return min(1.0, max(0.0, weight))


def terms_of(text: str) -> set[str]:
    """Words and stems of a text, as lexicon terms."""
    words = {w for w in map(folded, set(text.lower().split())) if 3 <= len(w) <= 24}
    return {f"w:{w}" for w in words} | {f"s:{w[:n]}" for w in words for n in STEMS if len(w) > n}


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, float], ...]
    weights: tuple[float, ...]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def _sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, keep: Column, sample: int) -> DataFrame:
    """(text, toxic) of about ``sample`` labelled rows; the sampled labels are small enough to broadcast."""
    labels = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & keep)
    total = labels.count()
    if total > sample:
        labels = labels.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / total)))
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(labels), "id").select("text", "toxic")


def _term_counts(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """(term, toxic, n): documents that have a term; only toxic ones if ``among`` is None."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            at = 0
            for part in byte_slices(batch.column(0)):
                for x in part:
                    terms = terms_of(x.decode("utf-8", "replace"))
                    found[labels[at]].update(terms if among is None else terms & among)
                    at += 1
        for label, counts in found.items():
            items = list(counts.items())
            for i in range(0, len(items), 50_000):
                part_items = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part_items]), pa.array([label] * len(part_items), pa.int32()), pa.array([n for _, n in part_items], pa.int64())], ["term", "toxic", "n"])

    return rows.mapInArrow(released(count), "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from labelled rows for which ``keep``, a condition on the column id, holds."""
    bounded_batches(docs.sparkSession)
    rows = stored(_sampled(docs, labels, doc_id, text, toxic, keep, sample))  # read several times
    distinct = rows.dropDuplicates(["text", "toxic"])  # a term isn't learned from copies of a text
    sizes = {r["toxic"]: r["count"] for r in distinct.groupBy("toxic").count().collect()}
    good, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not good or not bad:
        return Model((), (0.0 if not good and bad else -4.0, *[0.0] * FEATURES))
    frequent = _term_counts(distinct.filter("toxic = 1"), None).filter(F.col("n") >= min(MIN_TOXIC, max(2, bad // 20)))
    toxic_in = {r["term"]: r["n"] for r in frequent.collect()}  # bounded by the sample
    other = {r["term"]: r["n"] for r in _term_counts(distinct.filter("toxic = 0"), frozenset(toxic_in)).collect()}
    terms = _chosen(toxic_in, other, bad, good)

    bounded_batches(docs.sparkSession)

    @arrow_udf("array<double>")
    @released
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(terms)
        for arr in batches:
            yield pa.array([list(row) for part in byte_slices(arr) for row in scorer.rows([x.decode("utf-8", "replace") for x in part])], pa.list_(pa.float64()))

    # equal rows of features are counted before they are collected
    table = rows.select(features("text").alias("f"), "toxic").groupBy("f", "toxic").count().collect()
    x, y, n = np.array([r["f"] for r in table]).reshape(-1, FEATURES), np.array([r["toxic"] for r in table], float), np.array([r["count"] for r in table], float)
    return Model(terms, tuple(_fitted(x, y, n)))


def _chosen(toxic_in: dict[str, int], other: dict[str, int], bad: int, good: int) -> tuple[tuple[str, float], ...]:
    """Terms of high lift and precision with their log odds, the most telling first; words that a chosen stem already covers
    only for their misspellings, other terms that it covers not at all."""
    ranked = []
    for term, n in toxic_in.items():
        rest = other.get(term, 0)
        lift = (n / bad) / ((rest + 0.5) / good)
        if lift >= MIN_LIFT and n / (n + rest) >= MIN_PRECISION:
            ranked.append((-round(n * math.log(lift), 6), term[0] == "s", len(term), term, round(math.log(lift), 6)))
    chosen: dict[str, float] = {}
    for *_, term, odds in sorted(ranked):
        text = term[2:]
        if len(chosen) < TERMS and not any(f"s:{text[:k]}" in chosen for k in STEMS) and not (term[0] == "s" and any(c.startswith(f"w:{text}") and toxic_in[c] >= toxic_in[term] for c in chosen)):
            chosen[term] = odds
    covered = [(f"n:{term[2:]}", odds) for *_, term, odds in sorted(ranked) if term[0] == "w" and term not in chosen and any(f"s:{term[2 : 2 + k]}" in chosen for k in STEMS)]
    return (*chosen.items(), *covered)


def _fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the constant comes first."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def scores(text: Column, model: Model) -> Column:
    """Column of double: toxicity of ``text``, 0 to 1."""

    bounded_batches(SparkSession.active())

    @arrow_udf("double")
    @released
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model.terms)
        for arr in batches:
            rows = [row for part in byte_slices(arr) for row in scorer.rows([x.decode("utf-8", "replace") for x in part])]
            yield pa.array(model.score(np.array(rows).reshape(-1, FEATURES)), pa.float64())

    return score.asNondeterministic()(text)  # not to be run once for a filter and once for the column


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 5) == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= 0.5); columns of these names are replaced."""
    model = learn(docs, labels, ~held_out(F.col("id")), doc_id, text, toxic, sample)
    return docs.withColumns({"held_out": held_out(F.col(doc_id)), "score": scores(F.col(text), model)}).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
