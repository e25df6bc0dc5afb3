"""Language model scores by a probabilistic suffix tree over tokens.

The tree's nodes are contexts of up to DEPTH preceding tokens. A context is retained if some token follows it LEAST times
or more in the training texts and diverges there from its estimate after the next shorter context (a log-likelihood
ratio of GAIN or more); the suffixes of a retained context are retained with it. A token is scored in the longest
retained suffix of what precedes it: counts after a context are smoothed by MASS[k] tokens' worth of the distribution
after its own suffix. After contexts of two tokens or more, tokens whose pair with the last one occurs once in all texts
aren't counted, and what they have goes to the shorter context too; so every distribution sums to 1. The root discounts
counts and gives what it takes to one unknown symbol. Nothing is cut by share or rank: the tree holds whatever the
training texts make it hold.

The tree is never in one place. Documents become chunks of some million tokens: numbers into the chunk's own sorted
list of word hashes, stored once in buckets by chunk. Three exchanges follow. In each, a chunk sends its distinct runs
of tokens (64-bit hashes, sorted, once for each chunk however often they occur) with what it knows of them, in slices
by range of the hash; the task of a range adds up what all chunks sent and answers each in its own order. The first
gives the counts of words and pairs, the second those of longer runs of pairs that recur, the third which contexts are
retained and how often a lone pair follows them. Then each chunk has all it needs for its scores.
Counts are exact and global, so scores don't depend on how the texts are dealt. A run that every text holds is still one
row of each chunk, and ranges of hashes are even, so no key is hot; PART bounds what a range's task holds, CHUNK (and the
longest text) what a chunk's does. A slice has about CHUNK * PART / (all tokens) keys, one at least: for corpora of many
billions of tokens both should grow with the executors' memory, so that slices stay longer than what a row costs. Two different runs would have to share 64 bits to be taken for one.

Defined results: a null or empty text is one end mark; a null doc_id is not held out; a repeated row is scored by itself
and trains by itself; without training documents all counts are 0 and every token is the unknown, of probability 1; extra
columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, bucket_of, byte_slices, parallelism, scratch, stored

#: Longest context, in tokens.
DEPTH = 3
#: Tokens of the shorter context's distribution that smooth counts after a context of 1, 2 and 3 tokens.
MASS = (300.0, 30.0, 8.0)
#: A token must follow a context so often, and with such a log-likelihood ratio, to have the context retained.
LEAST, GAIN = 2, 4.0
#: The end of a text, as a token; words hold no space.
END = b" "
#: Tokens of a chunk, beyond which it takes no further text.
CHUNK = 1_500_000
#: Runs that a range of hashes is meant to hold of all chunks together.
PART = 1_000_000
#: Most buckets of the stored chunks.
BUCKETS = 20_000
_CODEC = "zstd"
#: Bits below a context's flags, for a count.
_FLAG = np.uint64(40)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, of which the empty ones cost nothing."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), _CODEC, asbytes=True)


def unpacked(data: bytes, n: int, kind: type = np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = pa.decompress(data, n * width, _CODEC, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=np.uint64(0))


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run and the word after it."""
    x = (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def edges(parts: int) -> np.ndarray:
    """First hash of each of ``parts`` even ranges."""
    return np.array([(k << 64) // parts for k in range(parts)], np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each key's place among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], place


def totals(place: np.ndarray, n: int, which: np.ndarray) -> np.ndarray:
    """How often each of n keys stands at the places that ``which`` marks."""
    return np.bincount(place[which], minlength=n).astype(np.uint64)


class Numbers(dict):
    """Words by the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Tokens of some texts one after another, as places in a sorted list of word hashes, with what is known of their runs.

    Arrays over tokens tell of the run that ends there: ``place[k]`` is its place in ``keys[k]``, -1 where it isn't asked
    for, and ``n[k]`` how often runs of k tokens occur in training texts.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, held: np.ndarray, words: np.ndarray):
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.room = np.arange(len(ids), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), lengths)
        self.train = np.repeat(~held, lengths)
        self._hashes = words[ids]
        self.keys, self.place = {1: words}, {1: ids}
        self._run = self._hashes
        self._ask(2, self.room >= 1)
        self.n: dict[int, np.ndarray] = {}

    def _ask(self, k: int, which: np.ndarray) -> None:
        """Number the distinct runs of k tokens that end at the marked places; runs of k - 1 must have been asked before."""
        run = np.zeros(len(which), np.uint64)
        run[1:] = mixed(self._run[:-1], self._hashes[1:])
        self._run = run
        at = np.flatnonzero(which)
        self.keys[k], found = distinct(run[at])
        self.place[k] = np.full(len(which), -1, np.int32)
        self.place[k][at] = found

    def own(self, k: int) -> np.ndarray:
        """How often each asked run of k tokens ends in the chunk's training texts."""
        return totals(self.place[k], len(self.keys[k]), self.train & (self.place[k] >= 0))

    def learn_pairs(self, answers: dict[int, np.ndarray]) -> None:
        """Take the counts of words and pairs, and ask for longer runs all of whose pairs recur."""
        for k in (1, 2):
            self.n[k] = _at(answers[k], self.place[k])
        recurs = self.n[2] >= 2
        every = recurs
        for k in range(3, DEPTH + 2):
            every = np.r_[False, every[:-1]] & recurs & (self.room >= k - 1)
            self._ask(k, every)
            self.n[k] = np.zeros(len(every), np.int64)
        self._run = self._hashes = np.zeros(0, np.uint64)

    def learn_runs(self, answers: dict[int, np.ndarray]) -> None:
        for k in range(3, DEPTH + 2):
            asked = self.place[k] >= 0
            self.n[k][asked] = _at(answers[k], self.place[k][asked])

    def _after(self, k: int, total: int) -> tuple[np.ndarray, ...]:
        """Places with a context of k tokens; counts of it with the token there, of it, and of both without its first token."""
        at = np.flatnonzero(self.room >= k)
        shorter = self.n[k - 1][at - 1] if k > 1 else np.full(len(at), total)
        return at, self.n[k + 1][at], self.n[k][at - 1], self.n[k][at], shorter

    def contexts(self) -> dict[int, np.ndarray]:
        """For each k the places in keys[k] of contexts that may be retained."""
        out = {}
        for k in range(1, DEPTH + 1):
            often = np.zeros(len(self.keys[k]), bool)
            often[self.place[k][(self.n[k] >= LEAST) & (self.place[k] >= 0)]] = True
            out[k] = np.flatnonzero(often)
        return out

    def diverging(self, total: int) -> dict[int, np.ndarray]:
        """For each k, by place in keys[k], whether texts here show that the context or one that it ends is to be retained."""
        out: dict[int, np.ndarray] = {}
        longer = np.zeros(len(self.room), bool)
        for k in range(DEPTH, 0, -1):
            at, pair, seen, less, whole = self._after(k, total)
            some = pair >= LEAST
            at, pair, seen, less, whole = at[some], pair[some], seen[some], less[some], whole[some]
            ratio = np.log(pair.astype(float) * whole / (seen.astype(float) * less))
            longer[at[pair * np.abs(ratio) >= GAIN] - 1] = True
            out[k] = np.zeros(len(self.keys[k]), bool)
            out[k][self.place[k][longer]] = True
        return out

    def lone(self, k: int) -> np.ndarray:
        """By place in keys[k], how often a pair that occurs once follows the context in the training texts here."""
        at = np.flatnonzero((self.room >= k) & (self.n[2] == 1) & self.train) - 1
        return totals(self.place[k][at], len(self.keys[k]), self.place[k][at] >= 0) if k > 1 else np.zeros(len(self.keys[k]), np.uint64)

    def scores(self, kept: dict[int, np.ndarray], lone: dict[int, np.ndarray], total: int, words: int, discount: float) -> np.ndarray:
        """log10 probability of each token; by place in keys[k], ``kept`` says whether a context is retained and ``lone`` how
        often a lone pair follows it."""
        unknown = discount * words / total if total else 1.0
        p = np.where(self.n[1] > 0, (self.n[1] - discount) / max(total, 1), unknown)
        for k in range(1, DEPTH + 1):
            at, pair, seen, _, _ = self._after(k, total)
            place = self.place[k][at - 1]
            good = (place >= 0) & kept[k][place] if len(kept[k]) else np.zeros(len(at), bool)
            at, pair, seen = at[good], pair[good], seen[good]
            p[at] = (pair + (MASS[k - 1] + lone[k][place[good]]) * p[at]) / (seen + MASS[k - 1])
        return np.log10(p)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)


def _at(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values at places, 0 at -1."""
    return np.r_[values, np.uint64(0)].astype(np.int64)[place]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 5) == 1, F.lit(False))


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Chunks of (text, held_out, doc_id): number, packed tokens and words, and their texts' lengths, flags and ids."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 33)
        index = Numbers()
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        others: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
            hashes, place = distinct(words)
            flat = place[np.concatenate(ids)].astype(np.uint32)
            held = pa.Table.from_batches(others)
            one = {"chunk": next(number), "tokens": len(flat), "ids": packed(flat), "words": packed(gaps(hashes)), "n_words": len(hashes), "lengths": lengths}
            arrays = [pa.array([v], t) for v, t in zip(one.values(), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            offsets = pa.array([0, held.num_rows], pa.int32())
            arrays += [pa.ListArray.from_arrays(offsets, held.column(c).combine_chunks()) for c in range(2)]
            return pa.RecordBatch.from_arrays(arrays, [*one, "held", "doc_ids"])

        size = 0
        for batch in batches:
            at = 0
            for part in byte_slices(batch.column(0)):
                lists = [tokens(t) for t in part]
                lengths += map(len, lists)
                ids.append(np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int32, sum(map(len, lists))))
                others.append(batch.slice(at, len(part)).select([1, 2]))
                at += len(part)
                size += len(ids[-1])
                if size >= chunk:
                    yield made()
                    index, ids, lengths, others, size = Numbers(), [], [], [], 0
        if lengths:
            yield made()

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(build, f"chunk long, tokens long, ids binary, words binary, n_words long, lengths array<long>, held array<boolean>, doc_ids array<{id_type}>")


_CHUNK = ["chunk", "ids", "words", "n_words", "lengths", "held"]
_ASKED = "part long, chunk long, size long, keys binary, n binary"


def _opened(batch: pa.RecordBatch, row: int) -> Chunk:
    get = {name: batch.column(name)[row] for name in _CHUNK}
    lengths = get["lengths"].values.to_numpy(zero_copy_only=False)
    words = np.cumsum(unpacked(get["words"].as_py(), get["n_words"].as_py()), dtype=np.uint64)
    ids = unpacked(get["ids"].as_py(), int(lengths.sum()), np.uint32).astype(np.int32)
    return Chunk(ids, lengths, get["held"].values.to_numpy(zero_copy_only=False).astype(bool), words)


def _asked(chunk: int, kind: int, parts: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A chunk's rows for the ranges that it has keys of, of one kind: never more rows than keys."""
    cut = np.r_[np.searchsorted(keys, edges(parts)), len(keys)]
    held = np.flatnonzero(cut[1:] > cut[:-1])
    spans = list(zip(cut[held].tolist(), cut[held + 1].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(kind * parts + held, pa.int64()),
            pa.array([chunk] * len(spans), pa.int64()),
            pa.array([b - a for a, b in spans], pa.int64()),
            pa.array([packed(gaps(keys[a:b])) for a, b in spans], pa.binary()),
            pa.array([packed(n[a:b]) for a, b in spans], pa.binary()),
        ],
        ["part", "chunk", "size", "keys", "n"],
    )


def _summed(asked: pa.Table) -> pa.Table:
    """One range: what all chunks sent of each key added up, and the sums in each chunk's own order. The first row
    also tells how many have a sum, one of 1, one of 2, and (as far as it fits) the sum of all."""
    rows = asked.to_pylist()
    keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["size"]), dtype=np.uint64) for r in rows])
    n = np.concatenate([unpacked(r["n"], r["size"]) for r in rows])
    found, place = distinct(keys)
    whole = np.zeros(len(found), np.uint64)
    np.add.at(whole, place, n)
    out, at = [], 0
    for r in rows:
        out.append(packed(whole[place[at : at + r["size"]]]))
        at += r["size"]
    stats = [[int((whole > 0).sum()), int((whole == 1).sum()), int((whole == 2).sum()), int(whole.sum()) & (1 << 62) - 1]] + [None] * (len(rows) - 1)
    return pa.table({"chunk": asked["chunk"], "part": asked["part"], "size": asked["size"], "n": pa.array(out, pa.binary()), "stats": pa.array(stats, pa.list_(pa.int64()))})


class Exchange:
    """Stored chunks and answers, in buckets by chunk, so that they meet without a shuffle."""

    def __init__(self, rows: DataFrame, chunk: int):
        spark = rows.sparkSession
        self.spark, self.tables = spark, []
        self.buckets = min(BUCKETS, 2 * max(1, rows.rdd.getNumPartitions()))
        self.chunks = self._kept(_chunks(rows, chunk))
        n = self.chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        self.parts = max(min(parallelism(spark), 32), n // PART)

    def _kept(self, df: DataFrame) -> DataFrame:
        name = f"millrace_{uuid.uuid4().hex}"
        df.write.option("path", scratch(self.spark, "chunks")).option("compression", "zstd").bucketBy(self.buckets, "chunk").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def met(self, answers: list[DataFrame], columns: list[str]) -> DataFrame:
        out = self.chunks.select(*columns)
        for k, df in enumerate(answers):
            out = out.join(df.select("chunk", F.col("rows").alias(f"rows{k}")), "chunk", "left")
        return out

    def asked(self, answers: list[DataFrame], send: Callable[[Chunk, list[dict[int, np.ndarray]]], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
        """The answers, stored, to what ``send`` gives of each chunk: kind of keys, keys and numbers."""
        parts, given = self.parts, len(answers)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    for kind, keys, n in send(_opened(batch, row), _answers(batch, row, given, parts)):
                        yield _asked(batch.column("chunk")[row].as_py(), kind, parts, keys, n)

        sent = self.met(answers, _CHUNK).mapInArrow(ask, _ASKED)
        # as many tasks as ranges, and as buckets, whatever the session's number of partitions
        back = sent.repartition(max(parallelism(self.spark), 3 * self.parts), "part").groupBy("part").applyInArrow(_summed, "chunk long, part long, size long, n binary, stats array<long>")
        listed = back.repartition(self.buckets, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "size", "n", "stats"))).alias("rows"))
        return self._kept(listed)  # a chunk's slices are as large as the chunk

    def word_stats(self, answers: DataFrame) -> tuple[int, int, int, int]:
        """Of words: how many occur, once, twice, and how often in all."""
        one = answers.select(F.explode("rows").alias("r")).filter((F.col("r.part") < 2 * self.parts) & F.col("r.stats").isNotNull())
        return tuple(one.agg(*[F.coalesce(F.sum(F.col("r.stats")[k]), F.lit(0)) for k in range(4)]).first())


def _answers(batch: pa.RecordBatch, row: int, given: int, parts: int) -> list[dict[int, np.ndarray]]:
    """By exchange and kind the numbers in the order of the chunk's own keys; none where it asked for none."""
    out = []
    for k in range(given):
        found: dict[int, list[np.ndarray]] = {}
        for r in batch.column(f"rows{k}")[row].as_py() or []:
            found.setdefault(r["part"] // parts, []).append(unpacked(r["n"], r["size"]))
        out.append(defaultdict(lambda: np.zeros(0, np.uint64), {kind: np.concatenate(x) for kind, x in found.items()}))
    return out


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"), held_out(F.col(doc_id)).alias("held_out"), F.col(doc_id).alias("doc_id"))
    exchange = Exchange(rows, chunk)
    try:
        return _scored(exchange, rows.schema["doc_id"].dataType.simpleString())
    finally:
        exchange.close()


def _scored(exchange: Exchange, id_type: str) -> DataFrame:
    def words_and_pairs(c: Chunk, known: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield from ((k, c.keys[k], c.own(k)) for k in (1, 2))

    pairs = exchange.asked([], words_and_pairs)
    distinct_words, once, twice, total = exchange.word_stats(pairs)
    discount = once / (once + 2 * twice) if once and twice else 0.5

    def longer(c: Chunk, known: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        c.learn_pairs(known[0])
        yield from ((k, c.keys[k], c.own(k)) for k in range(3, DEPTH + 2))

    runs = exchange.asked([pairs], longer)

    def contexts(c: Chunk, known: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        c.learn_pairs(known[0])
        c.learn_runs(known[1])
        good = c.diverging(total)
        for k, at in c.contexts().items():
            yield k, c.keys[k][at], good[k][at].astype(np.uint64) << _FLAG | c.lone(k)[at]

    kept = exchange.asked([pairs, runs], contexts)
    parts, norm = exchange.parts, float(np.log10(total + 0.5 * (distinct_words + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c, known = _opened(batch, row), _answers(batch, row, 3, parts)
                c.learn_pairs(known[0])
                c.learn_runs(known[1])
                retained, lone = {}, {}
                for k, at in c.contexts().items():
                    retained[k], lone[k] = np.zeros(len(c.keys[k]), bool), np.zeros(len(c.keys[k]))
                    retained[k][at] = known[2][k] >> _FLAG > 0
                    lone[k][at] = known[2][k] & ((np.uint64(1) << _FLAG) - np.uint64(1))
                base = c.sums(np.log10(c.n[1] + 0.5)) - c.lengths * norm
                fields = [
                    batch.column("doc_ids")[row].values,
                    batch.column("held")[row].values,
                    pa.array(c.lengths, pa.int64()),
                    pa.array(c.sums((c.n[1] > 0).astype(np.int64)), pa.int64()),
                    pa.array(np.full(len(c.lengths), total), pa.int64()),
                    pa.array(base),
                    pa.array(c.sums(c.scores(retained, lone, total, distinct_words, discount))),
                ]
                yield pa.RecordBatch.from_arrays(fields, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    made = exchange.met([pairs, runs, kept], [*_CHUNK, "doc_ids"]).mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return stored(made)
