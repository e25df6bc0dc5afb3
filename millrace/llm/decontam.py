"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

Texts and items are sequences of words (lower case, without the marks at their edges). A passage matches an item of L
words if it comes to it within floor(TOLERANCE * L) insertions, deletions and substitutions of words. Windows of an
item's size slide over each text and, by as many words as may be missing, over its ends; an edit breaks at most q runs of q words, so a window must hold a number of runs of
items of its size, and only windows that do are looked at. The others are embedded by the CGK random walk, under which few edits
give few Hamming differences: both sequences are read along shared random steps. Repeated samples of the
embedding's places are hashed; an item that shares a sample with a window is a candidate, whose edit distance is
computed exactly. Walks drift apart over many edits, so items of more than CUT words are looked up by overlapping parts of at
most PART: of parts that cover an item, one has no more than its share of the edits. The number of repetitions is set from a target recall and the share of places expected to agree; neighbouring windows
add to it.

Items are the stated query set: they go to the workers in blocks of at most BLOCK_BYTES, each matched with all rows.

Defined results: null or empty texts and items match nothing; equal items are each reported; an item with a null id keeps
it; occurrences of an item that overlap count once, as the closest of them; repeated rows are matched alike; extra
columns pass through unless the result has their name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.llm.common import bounded_batches, byte_slices, released

#: Edits allowed, as a share of an item's words: similarity of 0.8 or more.
TOLERANCE = 0.2
#: Places in a sample, and samples in all, spread over so many random walks.
PLACES, RECALL, AGREEING, WALKS = 4, 0.999, 0.5, 8
#: Steps of a walk that are kept, for each symbol: by then most walks are past the end.
READ = 2
#: Longest runs of words that windows are sifted by.
GRAMS = 4
#: Items of more words than CUT are looked up by parts of at most PART words.
CUT, PART = 29, 20
BLOCK_BYTES = 16 << 20
CACHE = 100_000
#: Stands for a word that no item has, and for what is past a sequence's end.
FOREIGN, PAST = -1, -2

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"\S+")


def samples(recall: float = RECALL, agreeing: float = AGREEING, places: int = PLACES) -> int:
    """Samples of ``places`` places that find a pair of which ``agreeing`` of the places agree with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreeing**places))


def parts(length: int) -> list[tuple[int, int]]:
    """(offset, words) of what an item is looked up by: itself, or parts that cover it and parts between their middles."""
    if length <= CUT:
        return [(0, length)]
    edges = np.linspace(0, length, -(-length // PART) + 1).astype(int).tolist()
    middles = [(a + b) // 2 for a, b in zip(edges, edges[1:], strict=False)]
    return [(a, b - a) for line in (edges, middles) for a, b in zip(line, line[1:], strict=False)]


def plain(chunk: str) -> str:
    """A lower-case chunk without the marks at its edges; one of marks only stays as it is."""
    return chunk if chunk.isalpha() else _EDGE.sub("", chunk) or chunk


def _mixed(a: np.ndarray, salt: int) -> np.ndarray:
    """64 well mixed bits of each number."""
    z = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def embedded(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of the windows of ``lengths`` symbols at ``starts``, one row each: every step writes the symbol under the
    pointer, and a random bit of (step, symbol), the same for all sequences, says whether the pointer moves on."""
    steps = READ * int(lengths.max(initial=0))
    out = np.full((steps, len(starts)), PAST, np.int64)
    pointer = np.zeros(len(starts), np.int64)
    for step in range(steps):
        symbol = np.where(pointer < lengths, ids[starts + np.minimum(pointer, lengths - 1)], PAST)
        out[step] = symbol
        pointer += (_mixed(symbol + 2, walk * 100_003 + step) >> np.uint64(63)).astype(np.int64)
    return out.T


def sample_keys(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, places: int = PLACES, walks: int = WALKS) -> np.ndarray:
    """(windows, samples): a hash of each sample of the embeddings' places; 0 for one that holds a foreign word or what is past the end."""
    each = -(-samples(places=places) // walks)
    out = np.zeros((len(starts), walks * each), np.uint64)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0, True]) if len(order) else np.zeros(1, np.int64)
    for walk in range(walks):
        embedding = embedded(ids, starts, lengths, walk)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = order[a:b]
            length = int(lengths[some[0]])
            rng = np.random.default_rng((length, walk))
            chosen = np.array([rng.choice(READ * length, min(places, READ * length), replace=False) for _ in range(each)])
            key = np.broadcast_to(np.arange(walk * each + 1, (walk + 1) * each + 1).astype(np.uint64), (len(some), each))
            void = np.zeros((len(some), each), bool)
            for k in range(chosen.shape[1]):
                symbol = embedding[some][:, chosen[:, k]]
                key = _mixed(key ^ (symbol + 2).astype(np.uint64), k)
                void |= symbol < 0
            out[some, walk * each : (walk + 1) * each] = np.where(void, 0, key)
    return out


def closest(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``text`` closest to ``item`` by edits of words: the earliest end, then the latest start."""
    distance, end = min((d, j) for j, d in enumerate(_distances(item, text, 0)))
    back = _distances(item[::-1], text[:end][::-1], 1)
    return distance, end - next(j for j, d in enumerate(back) if d == distance), end


def _distances(item: list[int], text: list[int], anchored: int) -> list[int]:
    """Edits between ``item`` and what ends at each place of ``text`` (0 included): any part of it, or all of it if anchored. Bit-parallel."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, x in enumerate(item):
        places[x] = places.get(x, 0) | 1 << i
    up, down, score, out = full, 0, m, [m]
    for y in text:
        equal = places.get(y, 0)
        cross = equal | down
        flat = (((equal & up) + up) ^ up) | equal
        more, less = down | ~(flat | up) & full, up & flat
        score += bool(more & top) - bool(less & top)
        out.append(score)
        more, less = (more << 1 | anchored) & full, less << 1 & full
        up, down = (less | ~(cross | more)) & full, more & cross
    return out


@dataclass(frozen=True)
class Hit:
    item: int
    start: int
    end: int
    distance: int


class Matcher:
    """Finds items in texts; keeps the number of each chunk it has met."""

    def __init__(self, items: list[str], tolerance: float = TOLERANCE, cache: int = CACHE):
        self.tolerance, self.cache = tolerance, cache
        words = [[plain(c) for c in t.lower().split()] for t in items]
        self.vocabulary: dict[str, int] = {}
        self.items = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for ws in words]
        self.chunks: dict[str, int] = {}
        self.tables: dict[int, dict[int, list[int]]] = {}
        by_length: dict[int, list[int]] = {}
        #: (item, offset, words) of what is looked up.
        self.units = [(i, a, n) for i, ids in enumerate(self.items) if ids for a, n in parts(len(ids))]
        for u, (_, _, n) in enumerate(self.units):
            by_length.setdefault(n, []).append(u)
        #: Runs of 1 to GRAMS words that items have, each as the number of its first words and the last one.
        self.grams: list[np.ndarray] = [np.zeros(0, np.int64)]
        known: list[dict[tuple[int, ...], int]] = [{}, {(i,): i for i in range(len(self.vocabulary))}]
        self.needs: dict[int, tuple[int, int, np.ndarray]] = {}
        for q in range(2, GRAMS + 1):
            keys = {tuple(x[i : i + q]): known[-1][tuple(x[i : i + q - 1])] << 32 | x[i + q - 1] for x in self.items for i in range(len(x) - q + 1)}
            values = np.array(list(keys.values()), np.int64)
            self.grams.append(np.unique(values))
            known.append(dict(zip(keys, np.searchsorted(self.grams[-1], values).tolist(), strict=True)))
        for length, some in sorted(by_length.items()):
            held = [self.items[i][a : a + n] for i, a, n in (self.units[u] for u in some)]
            flat = np.array([x for ids in held for x in ids], np.int64)
            table: dict[int, list[int]] = {}
            for u, keys in zip(some, sample_keys(flat, np.arange(len(some)) * length, np.full(len(some), length)).tolist(), strict=True):
                for key in filter(None, keys):
                    table.setdefault(key, []).append(u)
            self.tables[length] = table
            # the longest runs of which a match must still hold one
            q = max(q for q in range(1, min(GRAMS, length) + 1) if length - q + 1 - q * self.edits(length) >= 1)
            own = {tuple(ids[k : k + q]) for ids in held for k in range(length - q + 1)}
            self.needs[length] = (q, length - q + 1 - q * self.edits(length), np.array([known[q][g] for g in own], np.int64))
        self.gap = 1 + max(map(self.edits, by_length), default=0)
        self.known = np.array(sorted({k for t in self.tables.values() for k in t}), np.uint64)

    def edits(self, length: int) -> int:
        return int(self.tolerance * length + 1e-9)

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of the windows that may match an item of that length.

        An edit breaks q runs of q words at most, so a match holds at least length - q + 1 - q * edits runs of its item.
        Before, between and after the texts stand ``gap`` foreign words, more than a window may hold: it reaches over an
        end by what may be missing there, and never into two texts.
        """
        n = len(ids)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        gram = ids
        for q, known in enumerate(self.grams, 1):
            if q > 1:  # a run of q words is that of its first q - 1 and its last one
                gram = np.where(gram[:-1] == FOREIGN, FOREIGN, gram[:-1] << 32 | np.maximum(ids[q - 1 :], 0))
                at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                gram = np.where((gram != FOREIGN) & (known[at] == gram), at, FOREIGN) if len(known) else np.full(len(gram), FOREIGN)
            held[q] = (places := np.flatnonzero(gram != FOREIGN), gram[places])
        foreign = np.r_[np.int32(0), np.cumsum(ids == FOREIGN, dtype=np.int32)]
        for length in sorted(self.tables):
            q, need, own = self.needs[length]
            width = length - q + 1
            hits = held[q][0][np.isin(held[q][1], own)]
            if n < length or len(hits) < need:
                continue
            # a window with `need` hits holds so many neighbouring ones: its start lies between the two ends of what they allow
            low, high = np.maximum(hits[need - 1 :] - width + 1, 0), np.minimum(hits[: len(hits) - need + 1], n - length)
            good = low <= high
            marks = np.bincount(low[good], minlength=n + 2) - np.bincount(high[good] + 1, minlength=n + 2) if good.any() else np.zeros(1, np.int64)
            starts = np.flatnonzero(np.cumsum(marks) > 0)
            starts = starts[foreign[starts + length] - foreign[starts] <= self.edits(length)]
            if len(starts):
                yield length, starts

    def texts(self, texts: list[str]) -> list[list[Hit]]:
        """Hits of each text, by place: start and end count words."""
        if len(self.chunks) > self.cache:
            self.chunks = {}
        lists = [t.lower().split() for t in texts]
        new = set().union(*lists).difference(self.chunks)
        get = self.vocabulary.get
        self.chunks.update((c, get(plain(c), FOREIGN)) for c in new)
        lengths = np.array([len(x) for x in lists])
        ends = np.cumsum(lengths + self.gap)
        ids = np.full(int(lengths.sum()) + (len(lists) + 1) * self.gap, FOREIGN, np.int64)
        inside = np.arange(int(lengths.sum())) + np.repeat(np.arange(1, len(lists) + 1) * self.gap, lengths)
        ids[inside] = np.fromiter((i for x in lists for i in map(self.chunks.__getitem__, x)), np.int64, len(inside))
        found: list[list[Hit]] = [[] for _ in texts]
        kept = list(self.windows(ids))
        starts = np.concatenate([x for _, x in kept]) if kept else np.zeros(0, np.int64)
        sizes = np.repeat([n for n, _ in kept], [len(x) for _, x in kept]).astype(np.int64)
        places: dict[tuple[int, int], list[int]] = {}
        for at in range(0, len(starts), 20_000):
            some, lens = starts[at : at + 20_000], sizes[at : at + 20_000]
            keys = sample_keys(ids, some, lens)
            row, column = np.nonzero(np.isin(keys, self.known))
            pairs = {(s, u) for s, n, k in zip(some[row].tolist(), lens[row].tolist(), keys[row, column].tolist(), strict=True) for u in self.tables[n].get(k, ())}
            # past what a window may have before its text, it is inside
            docs = np.searchsorted(ends, np.array([s + self.edits(self.units[u][2]) for s, u in pairs], np.int64), "right").tolist()
            for (start, u), doc in zip(pairs, docs, strict=True):
                item, offset, _ = self.units[u]
                places.setdefault((doc, item), []).append(start - offset)
        for (doc, i), near in places.items():
            first, last = int(ends[doc] - lengths[doc]), int(ends[doc])
            length = len(self.items[i])
            most = self.edits(length)
            near.sort()
            runs = [[near[0], near[0]]]  # windows that overlap are looked at as one stretch
            for start in near[1:]:
                if start - runs[-1][1] <= most:
                    runs[-1][1] = start
                else:
                    runs.append([start, start])
            # edits before a part shift it against its item, as those inside shift its window
            slack = most if length <= CUT else 2 * most
            for a, b in runs:
                stretches = [(max(first, a - slack), min(last, b + length + slack))]
                while stretches:
                    left, right = stretches.pop()
                    distance, c, d = closest(self.items[i], ids[left:right].tolist())
                    if distance > most:
                        continue
                    found[doc].append(Hit(i, left + c - first, left + d - first, distance))
                    if d > c:  # other occurrences may stand beside this one
                        stretches += [(x, y) for x, y in ((left, left + c), (left + d, right)) if y - x >= length - most]
        return [apart(hits) for hits in found]


def apart(hits: list[Hit]) -> list[Hit]:
    """The closest of overlapping occurrences of an item, in order of place."""
    out: list[Hit] = []
    for hit in sorted(set(hits), key=lambda h: (h.item, h.distance, h.start, h.end)):
        if not any(o.item == hit.item and o.start < hit.end and hit.start < o.end for o in out):
            out.append(hit)
    return sorted(out, key=lambda h: (h.start, h.end, h.item))


_HITS = "array<struct<item_id: bigint, start: int, end: int, words: int, distance: int>>"


def _matches(text: Column, ids: list[int | None], items: list[str], tolerance: float) -> Column:
    shared = SparkSession.active().sparkContext.broadcast((ids, items))

    @arrow_udf(_HITS)
    @released
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, texts = shared.value
        matcher = Matcher(texts, tolerance)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("distance", pa.int32())]))
        for arr in batches:
            out = []
            for part in byte_slices(arr):
                whole = [x.decode("utf-8", "replace") for x in part]
                for body, found in zip(whole, matcher.texts(whole), strict=True):
                    spans = [m.span() for m in _WORD.finditer(body)] if found else []
                    out.append([{"item_id": names[h.item], "start": spans[h.start][0], "end": spans[h.end - 1][1], "words": h.end - h.start, "distance": h.distance} for h in found])
            yield pa.array(out, kind)

    return hits.asNondeterministic()(text)  # not to be run once for a filter and once for the column


def matches(text: Column, items: DataFrame, item_id: str = "item_id", item_text: str = "text", tolerance: float = TOLERANCE) -> Column:
    """Column of array<struct<item_id, start, end, words, distance>>: passages of ``text`` that match items; start and end count code points."""
    bounded_batches(items.sparkSession)
    held = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    size = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    made = []
    for k in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        made.append(_matches(text, [r["i"] for r in rows], [r["t"] for r in rows], tolerance))
    return F.concat(*made) if len(made) > 1 else made[0]


def with_matches(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """``docs`` with matches."""
    return docs.withColumn("matches", matches(F.col(text), items, **names))
