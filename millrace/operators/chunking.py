"""Chunks of sentences, by words or by tokens. Where a chunk ends depends on where the one before it did, so chunks are cut in
one pass over each row's sentences, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.functions import scalars, text

#: Pieces between Unicode white space, as scalars.words has them.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: What str.split() takes for white space beside that.
_ODD = re.compile("[\x1c-\x1f]")


def _count(x: str) -> int:
    return sum(1 for _ in _WORD.finditer(x)) if _ODD.search(x) else len(x.split())


def _texts(x: list | None) -> list[str]:
    return [s for s in x or [] if s is not None]


#: Rows of a batch that are Python objects at a time.
SLICE = 128


def _by_slices(cut: Callable[..., list[str]], *columns: pa.Array) -> pa.Array:
    """``cut`` of each row, a slice of the batch after another, so that Python's copies of the texts don't grow with the batch."""
    kind = pa.list_(pa.string())
    done = [pa.array([cut(*row) for row in zip(*[c.slice(i, SLICE).to_pylist() for c in columns], strict=True)], kind) for i in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _cut(cut: Callable[[list[str]], list[str]], sentences: Column) -> Column:
    """Column of array<string>: ``cut`` of each row's sentences, without nulls."""

    @arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield _by_slices(lambda x: cut(_texts(x)), arr)

    return of(sentences)


def chunked(sentences: Column, target_words: int = 100) -> Column:
    """Runs of sentences of at most so many words; a longer sentence is a chunk of its own."""

    def cut(parts: list[str]) -> list[str]:
        out: list[str] = []
        opened: list[str] = []
        held = 0
        for s in parts:
            n = _count(s)
            if held and held + n > target_words:
                out.append(" ".join(opened))
                opened, held = [], 0
            opened.append(s)
            held += n
        return [*out, " ".join(opened)] if held else out

    return _cut(cut, sentences)


def text_chunks(body: Column, target_tokens: int = 400) -> Column:
    """Chunks of a text, of a quarter of so many tokens in words."""
    return chunked(text.sentences(body), max(1, target_tokens // 4))


def token_counts(chunks: Column) -> Column:
    return F.transform(chunks, lambda x: scalars.word_tokens(x))


def total_tokens(chunks: Column) -> Column:
    return F.aggregate(token_counts(chunks), F.lit(0).cast("long"), lambda a, b: a + b)


def budgeted(body: Column, target_tokens: int = 400) -> Column:
    """Chunks of a text cut at . ! and ?, each of at most so many estimated tokens; the marks themselves go."""
    parts = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"[.!?]+"), lambda x: F.btrim(x)), lambda x: x != "")

    def cut(parts: list[str]) -> list[str]:
        out: list[str] = []
        opened: list[str] = []
        held = 0
        for s in parts:
            # a joined ". " stands at a word, so words add up; 1.3 tokens for each, as word_tokens has them
            n = _count(s)
            if opened and max(1, int((held + n) * 1.3)) > target_tokens:
                out.append(". ".join(opened))
                opened, held = [], 0
            opened.append(s)
            held += n
        return [*out, ". ".join(opened)] if opened else out

    return _cut(cut, parts)


def guarded(sentences: Column, spans: Column, target_words: int = 100) -> Column:
    """As ``chunked``, but a chunk waits to end, up to twice its size, while it holds the first word of a span and not the whole."""

    def cut(parts: list[str], spans: list[str]) -> list[str]:
        firsts = [(x.split(" ", 1)[0], x) for x in spans]
        out: list[str] = []
        opened: list[str] = []
        held = 0
        for s in parts:
            n = _count(s)
            if held and held + n > target_words:
                # a chunk is at most twice its size when it is looked at
                body = " ".join(opened)
                if held >= 2 * target_words or not any(a in body and x not in body for a, x in firsts):
                    out.append(body)
                    opened, held = [], 0
            opened.append(s)
            held += n
        return [*out, " ".join(opened)] if held else out

    @arrow_udf("array<string>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for parts, held in batches:
            yield _by_slices(lambda x, y: cut(_texts(x), _texts(y)), parts, held)

    return of(sentences, spans)
