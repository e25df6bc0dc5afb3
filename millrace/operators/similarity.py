"""Duplicates among short texts: exact, and by the Ratcliff-Obershelp ratio, whose greedy order is that of the input."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Rewritings before two requirements are compared.
REWRITES = [(r"\([^)]*\)", " "), (r"\b(?:strong|excellent|good|solid|proven)\b", " "), (r"(\d+)\+?\s*(?:years?|yrs?)", r"\1 years"), (r"[^\w\s]", " "), (r"\b(?:the|a|an)\b", " "), (r"\s+", " ")]
#: The steps of REWRITES, the last ones over words: between white space and marks they are the same.
_BRACKETS, _PRAISE, _YEARS, _MARKS = (re.compile(p) for p, _ in REWRITES[:4])
_PRAISED = ("strong", "excellent", "good", "solid", "proven")
_ARTICLES = {"the", "a", "an"}


@lru_cache(maxsize=1 << 14)
def comparable(text: str) -> str:
    out = text.lower()
    if "(" in out:
        out = _BRACKETS.sub(" ", out)
    if any(w in out for w in _PRAISED):
        out = _PRAISE.sub(" ", out)
    if "year" in out or "yr" in out:
        out = _YEARS.sub(r"\1 years", out)
    return " ".join([w for w in _MARKS.sub(" ", out).split() if w not in _ARTICLES])


def likeness(a: str, b: str) -> float:
    """1 for equal texts, else the ratio of common runs, raised where one text holds the other."""
    x, y = comparable(a), comparable(b)
    if x == y:
        return 1.0
    ratio = SequenceMatcher(None, x, y).ratio()
    if x and y and (x in y or y in x):
        share = min(len(x), len(y)) / max(len(x), len(y))
        ratio = max(ratio, share * (1.1 if min(len(x), len(y)) > 40 else 1.0))
    return ratio


class _Kept:
    """A text that others are held against: what is asked of it again and again is made once."""

    __slots__ = ("full", "masks", "matcher", "text")

    def __init__(self, text: str):
        self.text, self.full = text, (1 << len(text)) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.matcher: SequenceMatcher | None = None

    def common(self, x: str) -> int:
        """Length of the longest common subsequence, bit-parallel: the ratio's runs can't hold more."""
        rest, full, masks = self.full, self.full, self.masks
        for c in x:
            hit = rest & masks.get(c, 0)
            rest = ((rest + hit) | (rest - hit)) & full
        return len(self.text) - rest.bit_count()

    def like(self, x: str, threshold: float) -> bool:
        """Whether the likeness of ``x`` to this text, both comparable, is ``threshold`` or more."""
        y = self.text
        if x == y:
            return threshold <= 1.0
        short, long = sorted((len(x), len(y)))
        if short and (x in y or y in x) and short / long * (1.1 if short > 40 else 1.0) >= threshold:
            return True
        # what bounds the ratio from above settles most pairs
        if 2.0 * short / (short + long) < threshold or 2.0 * self.common(x) / (short + long) < threshold:
            return False
        if self.matcher is None:
            self.matcher = SequenceMatcher(None, "", y)
        self.matcher.set_seq1(x)
        return self.matcher.ratio() >= threshold


def distinct_texts(texts: list[str], threshold: float = 0.8) -> list[str]:
    """The longest first, each kept if it is like none kept before."""
    kept: list[str] = []
    held: list[_Kept] = []
    for text in sorted(texts, key=lambda t: (-len(t), t)):
        x = comparable(text)
        if not any(k.like(x, threshold) for k in held):
            kept.append(text)
            held.append(_Kept(x))
    return kept


def fuzzy_distinct(texts: Column, threshold: float = 0.8) -> Column:
    """Column of array<string>: the texts of a row's array that are unlike each other."""

    @arrow_udf("array<string>")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([distinct_texts([t for t in x or [] if t is not None], threshold) for x in arr.to_pylist()], pa.list_(pa.string()))

    return kept(texts)


def exact_distinct(df: DataFrame, text: str, score: str, group: list[str], order: list[str]) -> DataFrame:
    """The row of the highest score of each text (lower case, trimmed) of a group; more capitals, then the first, settle ties."""
    capitals = F.regexp_count(F.col(text), F.lit(r"\p{Lu}"))
    rank = F.row_number().over(Window.partitionBy(*group, F.lower(F.btrim(text))).orderBy(F.desc(score), F.desc(capitals), *order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def content_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(hash, first, n) of contents that several rows have; rows are not paired."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("hash")).agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")
