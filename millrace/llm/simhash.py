"""SimHash near-duplicates by bit-sliced comparison.

Each text's fingerprint has bit i set where over half of the 64-bit hashes of its word shingles have it. Equal
fingerprints become one row. Two fingerprints that differ in at most ``radius`` bits agree in one of radius + 1 bands
of bits, so candidates share a band's value; a bucket that is too large is split once more by bands of the remaining
bits (exact for the same reason), and what is still large is dealt out as pairs of blocks, so that no task holds more
than two blocks. Within a pair of blocks the fingerprints stand as vertical bit planes: differing planes are summed
by carry-save counters for 64 fingerprints per word, and words in which every lane is beyond the radius are dropped.
Each pair of blocks returns a spanning forest of its links; alternating large-star and small-star rounds join them.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; texts with fewer words
than a shingle hash the whole sequence; repeated rows keep their own row and share a component; a null doc_id keeps its
row and takes part in links, its component is the smallest id reachable that isn't null, else null. Extra columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.llm.common import bounded_batches, byte_slices, checkpointed, met, released

BITS = 64
SEED = 42
#: Fingerprints in a block; a task compares two blocks at most.
BLOCK = 4096
#: Fingerprints that share a band's value, as aimed at.
GROUP = 1024
#: Buckets of more fingerprints are split by bands of their remaining bits before they are dealt out in blocks.
SPLIT = 32 * BLOCK
#: Links from which on hot centres are looked for in each round.
LINKS = 100_000
#: Keys of dropped rows that are broadcast; beyond, rows and keys are shuffled.
BROADCAST_KEYS = 500_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of one text, as unsigned 64 bits."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    else:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """Column of int64: the fingerprint's bits, as a signed number."""
    bounded_batches(SparkSession.active())

    @arrow_udf("bigint")
    @released
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array(np.array([fingerprint(x, shingle) for part in byte_slices(arr) for x in part], np.uint64).view(np.int64), pa.int64())

    return of(text)


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes (BITS, words) of unsigned fingerprints: lane j of word w of plane b is bit b of fingerprint 64 * w + j."""
    padded = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with at most ``radius`` differing bits of left[i] and right[j]."""
    found_i, found_j = [], []
    flat = planes(right)
    words = flat.shape[1]
    counters = max(1, int(radius).bit_length())
    lanes = np.full(words, np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(right) % 64:
        lanes[-1] = np.uint64((1 << (len(right) % 64)) - 1)
    for base in range(0, len(left), 512):
        query = left[base : base + 512]
        row = np.repeat(np.arange(len(query)), words)
        word = np.tile(np.arange(words), len(query))
        asked = query[row]
        over = ~lanes[word]  # lanes beyond the radius for good
        count = [np.zeros(len(row), np.uint64) for _ in range(counters)]
        for b in range(BITS):
            carry = flat[b][word] ^ (np.uint64(0) - ((asked >> np.uint64(b)) & np.uint64(1)))
            for c in range(counters):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry
            if b % 8 == 7:
                over |= _above(count, radius)
                alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not alive.all():
                    row, word, over, asked = row[alive], word[alive], over[alive], asked[alive]
                    count = [c[alive] for c in count]
                    if not len(row):
                        break
        if len(row):
            hit = ~(over | _above(count, radius))
            some = np.flatnonzero(hit)
            lane = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(lane)
            found_i.append(base + row[some[at]])
            found_j.append(64 * word[some[at]] + bit)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is larger than ``radius``."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for c in range(len(count) - 1, -1, -1):
        if radius >> c & 1:
            equal &= count[c]
        else:
            above |= equal & count[c]
            equal &= ~count[c]
    return above


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each of n nodes under links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _bands(parts: int, width: int) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` runs over ``width`` bits."""
    edges = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(x: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(x, offset).bitwiseAND(F.lit((1 << width) - 1))


def _rest(x: Column, offset: int, width: int) -> Column:
    """``x`` without the bits of a band, closed up."""
    low = x.bitwiseAND(F.lit((1 << offset) - 1)) if offset else F.lit(0).cast("long")
    high = F.shiftleft(F.shiftrightunsigned(x, offset + width), offset) if offset + width < BITS else F.lit(0).cast("long")
    return high.bitwiseOR(low)


def links(prints: DataFrame, radius: int = 4, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """Spanning links (u, v), u < v, of distinct fingerprints ``fp`` within ``radius``: the components are those of all links."""
    # only as many bits of a band as leave about GROUP fingerprints to a value: fewer, fuller groups, the same links
    spread = max(1, (max(1, prints.count()) // GROUP).bit_length())
    outer = [(o, min(w, spread)) for o, w in _bands(radius + 1, BITS)]
    keyed = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("band"), _bits(F.col("fp"), o, w).alias("key"), _rest(F.col("fp"), o, w).alias("rest")) for k, (o, w) in enumerate(outer)])).alias("b"),
    ).select("fp", "b.*")
    sizes = keyed.groupBy("band", "key").count().filter("count > 1")
    # at most (radius + 1) * 2 ** 13 rows, whatever the input
    sized = keyed.join(F.broadcast(sizes), ["band", "key"])
    large = sized.filter(F.col("count") > split)
    narrow = BITS - max(w for _, w in outer)
    again = large.select(
        "fp",
        "band",
        "key",
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("sub"), _bits(F.col("rest"), o, w).alias("subkey")) for k, (o, w) in enumerate(_bands(radius + 1, narrow))])).alias("b"),
    ).select("fp", "band", "key", "b.*")
    resized = again.join(again.groupBy("band", "key", "sub", "subkey").count().filter("count > 1"), ["band", "key", "sub", "subkey"])
    whole = sized.filter(F.col("count") <= split).select("fp", "band", "key", F.lit(-1).cast("long").alias("sub"), F.lit(0).cast("long").alias("subkey"), "count").unionByName(resized.select("fp", "band", "key", "sub", "subkey", "count"))
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = whole.withColumn("blocks", blocks).withColumn("own", own)
    # block pairs (a, b), a <= b, of a bucket: each fingerprint goes to those that hold its own block
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("fp", "own", "band", "key", "sub", "subkey", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(key: tuple, frame: pa.Table) -> pa.Table:
        signed, (a, b) = frame["fp"].to_numpy(), (x.as_py() for x in key[4:])
        prints = signed.view(np.uint64)
        mine = frame["own"].to_numpy() == a
        if a == b:
            i, j = near(prints, prints, radius)
            i, j = i[i < j], j[i < j]
        else:
            left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
            i, j = near(prints[left], prints[right], radius)
            i, j = left[i], right[j]
        root = _forest(len(prints), i, j)
        member = np.flatnonzero(root != np.arange(len(prints)))
        u, v = signed[member], signed[root[member]]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return dealt.groupBy("band", "key", "sub", "subkey", "a", "b").applyInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over links (u, v), for nodes that have a link."""
    # large-star: each node's larger neighbours go to its smallest one; small-star: its smaller ones do
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    last = None
    count = edges.count()
    for _ in range(rounds):
        # a star of many links would meet its centre in one task
        join = met if count > LINKS else lambda rows, values, key: rows.join(values, key)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join(both.filter("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join(large, low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        count = now[0]
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id (smallest doc_id reachable), component (a fingerprint of it)."""
    marked = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), shingle).alias("fp")))
    return met(marked, grouped(marked, radius), "fp").select("doc_id", "fp", "component_id", "component")


def grouped(marked: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component_id, component) of each fingerprint in stored rows (doc_id, fp)."""
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(distinct.select("fp"), radius))
    linked = checkpointed(distinct.join(found, distinct["fp"] == found["node"]).select("fp", "low", "root"))
    # a root is a node too, whose row is not among the links' nodes
    roots = linked.select("root").distinct().join(distinct, F.col("root") == F.col("fp")).select("fp", "low", "root")
    least = linked.unionByName(roots).groupBy("root").agg(F.min("low").alias("component_id"))
    named = met(linked.select("fp", "root"), least, "root").unionByName(least.select("root", F.col("root").alias("fp"), "component_id"))
    alone = distinct.join(linked.select("fp").unionByName(roots.select("fp")).distinct(), "fp", "left_anti")
    return named.select("fp", "component_id", F.col("root").alias("component")).unionByName(alone.select("fp", F.col("low").alias("component_id"), F.col("fp").alias("component")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, one of the smallest id in it; rows without an id all stay.

    Rows are told apart by id and a 64-bit hash of the text; only these are shuffled, and the texts where more than
    BROADCAST_KEYS of them are dropped.
    """
    key = F.xxhash64(F.col(text))
    marked = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), key.alias("_h"), fingerprints(F.col(text), shingle).alias("fp")))
    rows = checkpointed(marked.filter("doc_id IS NOT NULL").groupBy("doc_id", "_h", "fp").count())
    placed = checkpointed(met(rows, grouped(marked.select("doc_id", "fp"), radius), "fp"))
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "_h")).alias("x")).select("x.*")
    ids, own = placed.select("doc_id", "_h", "count"), [F.col(doc_id).alias("_id"), key.alias("_h")]
    gone = checkpointed(ids.join(first, ["doc_id", "_h"], "left_anti").select(F.col("doc_id").alias("_id"), "_h"))
    again = checkpointed(ids.filter("count > 1").join(first, ["doc_id", "_h"], "left_semi").select(F.col("doc_id").alias("_id"), "_h"))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df

    kept = docs.select(F.struct(*docs.columns).alias("_own"), *own).join(small(gone), ["_id", "_h"], "left_anti")
    if not again.isEmpty():
        repeated = kept.join(small(again), ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
        kept = kept.join(small(again), ["_id", "_h"], "left_anti").unionByName(repeated)
    return kept.select("_own.*")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
