"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

The leaves of a word's tree hold (rank, place) of the pair that starts at each live symbol; the root is the leftmost
pair of lowest rank. A merge changes three leaves (its own, its left neighbour's, and the vanished one's), each a
logarithmic point update. Words of up to ``WIDE`` symbols are handled as rows of one array of trees, all roots at
a time; longer ones one by one with the same tree.

Defined results: null and empty texts give no ids and an empty decoded text; special tokens written in a text are
taken whole, as the library does by default; decoding joins tokens by one space, as a vocabulary without a decoder
asks for. Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.llm.common import bounded_batches, byte_slices, released
from millrace.llm.vocab import NONE, Vocabulary, vocabulary_bytes

#: The published word pattern of this vocabulary (a fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WIDE = 64
#: Distinct pieces whose ids a worker keeps; beyond it starts anew.
CACHE = 100_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: White space as Unicode defines it (a fixed value), for a class.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def encode_words(vocab: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each non-empty word."""
    out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
    flat, lengths = vocab.symbols(words)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    for i in np.flatnonzero(lengths > WIDE):
        out[i] = _one(vocab, flat[starts[i] : starts[i] + lengths[i]].tolist())
    size = 1
    while size <= WIDE:
        rows = np.flatnonzero((lengths > size // 2) & (lengths <= size))
        for part in np.array_split(rows, max(1, len(rows) * size // 2_000_000)):
            if len(part):
                _many(vocab, flat, starts[part], lengths[part], size, part, out)
        size *= 2
    return out


def _many(vocab, flat, starts, lengths, size, rows, out) -> None:
    """All words of size // 2 + 1 to ``size`` symbols; fills ``out``."""
    n, place = len(rows), np.arange(size)
    live = place < lengths[:, None]
    sym = np.where(live, flat[np.minimum(starts[:, None] + place, len(flat) - 1)], 0)
    after = np.broadcast_to(place + 1, (n, size)).copy()
    before = np.broadcast_to(place - 1, (n, size)).copy()
    tree = np.full((n, 2 * size), NONE * size, np.int64)
    if size > 1:
        pair = place[:-1] + 1 < lengths[:, None]
        rank = np.full((n, size - 1), NONE, np.int64)
        rank[pair] = vocab.pairs.ranks(sym[:, :-1][pair], sym[:, 1:][pair])
        tree[:, size : 2 * size - 1] = np.where(rank < NONE, rank * size + place[:-1], NONE * size)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        at = np.flatnonzero(tree[:, 1] < NONE * size)
        while len(at):
            root = tree[at, 1]
            left = root % size
            right = after[at, left]
            sym[at, left] = vocab.pairs.merged[root // size]
            live[at, right] = False
            nxt = after[at, right]
            after[at, left] = nxt
            inside = nxt < lengths[at]
            before[at[inside], nxt[inside]] = left[inside]
            tree[at, size + right] = NONE * size
            tree[at, size + left] = NONE * size
            a, x, y = at[inside], left[inside], nxt[inside]
            rank = vocab.pairs.ranks(sym[a, x], sym[a, y])
            tree[a, size + x] = np.where(rank < NONE, rank * size + x, NONE * size)
            prev = before[at, left]
            has = prev >= 0
            a, x, y = at[has], prev[has], left[has]
            rank = vocab.pairs.ranks(sym[a, x], sym[a, y])
            tree[a, size + x] = np.where(rank < NONE, rank * size + x, NONE * size)
            for a, leaf in ((at, left), (at, right), (a, x)):
                node = (leaf + size) // 2
                while len(node) and node[0] >= 1:
                    tree[a, node] = np.minimum(tree[a, 2 * node], tree[a, 2 * node + 1])
                    node = node // 2
            at = at[tree[at, 1] < NONE * size]
    ids = sym[live].astype(np.int32)
    for i, part in zip(rows.tolist(), np.split(ids, np.cumsum(live.sum(1))[:-1]), strict=True):
        out[i] = part


def _one(vocab, sym: list[int]) -> np.ndarray:
    """One long word."""
    n = len(sym)
    size = 1 << (n - 1).bit_length()
    none = int(NONE) * size
    rank_of, merged = vocab.pairs.scalar, vocab.pairs.merged
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    tree = [none] * (2 * size)

    def key(i: int, j: int) -> int:
        rank = rank_of.get((sym[i], sym[j]))
        return none if rank is None else rank * size + i

    def put(i: int, value: int) -> None:
        node = i + size
        tree[node] = value
        while node > 1:
            node //= 2
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                return
            tree[node] = low

    for i in range(n - 1):
        tree[size + i] = key(i, i + 1)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < none:
        rank, left = divmod(tree[1], size)
        right = after[left]
        sym[left] = int(merged[rank])
        live[right] = False
        nxt = after[left] = after[right]
        put(right, none)
        if nxt < n:
            before[nxt] = left
        put(left, key(left, nxt) if nxt < n else none)
        if before[left] >= 0:
            put(before[left], key(before[left], left))
    return np.array([s for s, x in zip(sym, live, strict=True) if x], np.int32)


class Codec:
    """Encodes and decodes texts, keeping the ids of pieces between white space."""

    def __init__(self, data: bytes, cache: int = CACHE):
        self.vocab = Vocabulary(data)
        self.pattern = regex.compile(WORD)
        self.space = re.compile(f"[{_SPACE}]+")
        self.cache = cache
        self.ids: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocab.special, key=len, reverse=True)))) if self.vocab.special else None
        self.tokens = pa.array(self.vocab.tokens, pa.string())

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [x for x in self.space.split(text) if x] if _ODD_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> pa.Array:
        """A list array of int32 ids."""
        if len(self.ids) > self.cache:
            self.ids = {}
        cut: list[list[str | bytes]] = []
        for text in texts:
            if self.special and "<|" in text and (found := self.special.findall(text)):
                pieces: list[str | bytes] = []
                for i, part in enumerate(self.special.split(text)):
                    if i:
                        pieces.append(np.int32(self.vocab.special[found[i - 1]]).tobytes())
                    pieces += self._pieces(part)
                cut.append(pieces)
            else:
                cut.append(self._pieces(text))  # type: ignore[arg-type]
        new = set().union(*cut) if cut else set()
        self._learn([x for x in new if isinstance(x, str) and x not in self.ids])
        get = self.ids.__getitem__
        rows = [b"".join(x if isinstance(x, bytes) else get(x) for x in p) if any(isinstance(x, bytes) for x in p) else b"".join(map(get, p)) for p in cut]  # type: ignore[arg-type]
        ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    def _learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        parts = [self.pattern.findall(p) for p in pieces]
        ids = encode_words(self.vocab, [w.encode() for p in parts for w in p])
        at = 0
        for piece, part in zip(pieces, parts, strict=True):
            self.ids[piece] = b"".join(x.tobytes() for x in ids[at : at + len(part)])
            at += len(part)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: their tokens joined by one space; null lists give an empty text."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
        tokens = pc.take(self.tokens, ids.flatten())
        lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), tokens), " ")


def encode(text: Column, vocabulary: str = "word_bpe_49k.json") -> Column:
    """Column of array<int>: the ids of ``text``; ``vocabulary`` is a path or the name of a public file, read on the driver."""
    return round_trip(text, vocabulary)["ids"]


def decode(ids: Column, vocabulary: str = "word_bpe_49k.json") -> Column:
    """Column of string: the text of an array<int> of ids."""
    shared = _shared(vocabulary)

    @arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value)
        for arr in batches:
            yield codec.decode(arr)

    return text_of(ids)


def round_trip(text: Column, vocabulary: str = "word_bpe_49k.json") -> Column:
    """Column of struct: the ids of ``text`` and the text decoded from them, made by one worker."""
    shared = _shared(vocabulary)

    @arrow_udf("struct<ids: array<int>, decoded: string>")
    @released
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value)
        for arr in batches:
            parts = [codec.encode([x.decode("utf-8", "replace") for x in part]) for part in byte_slices(arr)]
            ids = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([ids, codec.decode(ids)], ["ids", "decoded"])

    return both(text)


def _shared(vocabulary: str):
    session = SparkSession.active()
    bounded_batches(session)
    return session.sparkContext.broadcast(vocabulary_bytes(vocabulary))


def with_round_trip(df: DataFrame, text: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``decoded`` (their text); columns of these names are replaced."""
    names = [c for c in df.columns if c not in ("ids", "decoded")]
    made = df.select("*", round_trip(F.col(text), vocabulary).alias("_round_trip"))
    return made.select(*[F.col(f"`{c}`") for c in names], "_round_trip.ids", "_round_trip.decoded")
