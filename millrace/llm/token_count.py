"""Token counts by rank-synchronous merging over ragged arrays.

Texts are cut into pre-tokens, each distinct pre-token is a run of byte symbols in one flat array, and in every
round each run applies all places of its own lowest-ranked pair at once. A merge can only make pairs of higher
rank than its own, so this gives what merging one place at a time gives. The count is the symbols that survive.

Defined results: a null or empty text has 0 bytes and 0 tokens; the strings of special tokens inside a text count
as one token each; texts of any length are handled whole, in slices of bounded size; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.llm.common import bounded_batches, byte_slices
from millrace.llm.vocab import NONE, Vocabulary, vocabulary_bytes

#: The published pre-token pattern of byte-level BPE (a fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces whose counts a worker keeps; beyond it starts anew.
CACHE = 400_000
#: White space before and after a space: only there do runs of white space reach over the spaces that texts are cut at.
WIDE = re.compile(r"\s \s|[\x1c-\x1f]")


def merged_lengths(vocab: Vocabulary, words: list[bytes]) -> np.ndarray:
    """How many symbols of each non-empty word survive all merges."""
    sym, lengths = vocab.symbols(words)
    out = np.zeros(len(words), np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    rank = _pair_ranks(vocab, sym, word)
    while len(sym):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(sym)])
        low = np.minimum.reduceat(rank, starts)
        done = low == NONE
        if done.any():
            out[word[starts[done]]] = sizes[done]
            keep = np.repeat(~done, sizes)
            sym, word, rank = sym[keep], word[keep], rank[keep]
            sizes, low = sizes[~done], low[~done]
            if not len(sym):
                break
        hit = rank == np.repeat(low, sizes)
        at = np.flatnonzero(hit)
        # of overlapping places (a pair of equal symbols in a row) every other one merges, from the left
        run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
        sym[at] = vocab.pairs.merged[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = np.cumsum(keep) - 1
        sym, word, rank = sym[keep], word[keep], rank[keep]
        changed = new[at]
        changed = np.union1d(changed, changed[changed > 0] - 1)
        rank[changed] = _pair_ranks(vocab, sym, word, changed)
    return out


def _pair_ranks(vocab: Vocabulary, sym, word, at=None):
    at = np.arange(len(sym)) if at is None else at
    out = np.full(len(at), NONE, np.int64)
    pair = np.flatnonzero(at + 1 < len(sym))
    pair = pair[word[at[pair]] == word[at[pair] + 1]]
    out[pair] = vocab.pairs.ranks(sym[at[pair]], sym[at[pair] + 1])
    return out


class Counter:
    """Counts tokens of texts, keeping the counts of pieces between spaces."""

    def __init__(self, data: bytes, cache: int = CACHE):
        self.vocab = Vocabulary(data)
        self.pattern = regex.compile(PRE_TOKEN)
        self.cache = cache
        self.first: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocab.special, key=len, reverse=True)))) if self.vocab.special else None

    def count(self, texts: list[str]) -> list[int]:
        if len(self.first) + len(self.spaced) > self.cache:
            self.first, self.spaced = {}, {}
        plain: list[tuple[int, str]] = []
        out = [0] * len(texts)
        for i, text in enumerate(texts):
            if self.special and "<|" in text and self.special.search(text):
                pieces = self.special.split(text)
                out[i] += len(pieces) - 1
                plain += [(i, p) for p in pieces if p]
            elif text:
                plain.append((i, text))
        cut = [(i, None, self.pattern.findall(t)) if WIDE.search(t) else (i, *_heads(t)) for i, t in plain]
        self._learn(cut)
        first, spaced = self.first.__getitem__, self.spaced.__getitem__
        for i, head, rest in cut:
            out[i] += sum(map(first, rest)) if head is None else sum(map(spaced, rest)) + (first(head) if head else 0)
        return out

    def _learn(self, cut) -> None:
        new_first, new_spaced = set(), set()
        for _, head, rest in cut:
            if head is None:
                new_first.update(rest)
            else:
                new_spaced.update(rest)
                if head:
                    new_first.add(head)
        new_first.difference_update(self.first)
        new_spaced.difference_update(self.spaced)
        for cache, new, lead in ((self.first, new_first, ""), (self.spaced, new_spaced, " ")):
            if not new:
                continue
            pieces = list(new)
            parts = [self.pattern.findall(lead + p) for p in pieces]
            words = [w.encode() for p in parts for w in p]
            totals = np.add.reduceat(merged_lengths(self.vocab, words), np.r_[0, np.cumsum([len(p) for p in parts])[:-1]])
            cache.update(zip(pieces, totals.tolist(), strict=True))


def _heads(text: str) -> tuple[str, list[str]]:
    head, *rest = text.split(" ")
    return head, rest


def token_counts(text: Column, vocabulary: str = "byte_bpe_50k.json") -> Column:
    """Column of int64 token counts of ``text``; ``vocabulary`` is a path or the name of a public file, read on the driver."""
    session = SparkSession.active()
    bounded_batches(session)
    shared = session.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    @arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shared.value)
        for arr in batches:
            yield pa.array([n for part in byte_slices(arr) for n in counter.count([x.decode("utf-8", "replace") for x in part])], pa.int64())

    return count(text)


def with_token_counts(df: DataFrame, text: str = "text", limit: int = 512, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > limit); columns of these names are replaced."""
    return df.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"), "n_tokens": token_counts(F.col(text), vocabulary)}).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
