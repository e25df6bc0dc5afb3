"""Elements of HTML by CSS selectors: types, classes, ids, attributes, descendants, children and lists of these."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SIMPLE = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""")


@dataclass(eq=False)
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    start: int = 0
    end: int = 0
    texts: list[str] = field(default_factory=list)


class _Reader(HTMLParser):
    """Elements in order of their start, with the place of what is inside them and their texts."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.found: list[Element] = []
        self.open: list[Element] = []
        self.size = len(source)
        self._lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.feed(source)
        self.close()
        while self.open:
            self.open.pop().end = self.size

    def _at(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        at = self._at() + len(self.get_starttag_text() or "")
        new = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1] if self.open else None, at, at)
        self.found.append(new)
        if tag not in VOID:
            self.open.append(new)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open):
            at = self._at()
            while (last := self.open.pop()).tag != tag:
                last.end = at
            last.end = at

    def handle_data(self, data):
        for e in self.open:
            e.texts.append(data)


def _compound(text: str) -> list[dict]:
    parts, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"selector not understood: {text}")
        parts.append(m.groupdict())
        at = m.end()
    return parts


@lru_cache(256)
def parsed(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Alternatives, each a list of (combinator, simple selectors) from left to right; ValueError for what isn't known."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        tokens = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one.strip())
        chain, combinator = [], " "
        for token in tokens:
            if token == ">":
                combinator = ">"
            else:
                chain.append((combinator, _compound(token)))
                combinator = " "
        if not chain or combinator == ">" or tokens[0] == ">":
            raise ValueError(f"selector not understood: {selector}")
        out.append(chain)
    return out


def _is(e: Element, parts: list[dict]) -> bool:
    for p in parts:
        if p["tag"]:
            good = p["tag"] in ("*", e.tag) or p["tag"].lower() == e.tag
        elif p["cls"]:
            good = p["cls"] in e.attributes.get("class", "").split()
        elif p["id"]:
            good = e.attributes.get("id") == p["id"]
        else:
            have, want = e.attributes.get(p["name"].lower()), p["dq"] or p["sq"] or p["bare"] or ""
            tests = {None: lambda: True, "=": lambda: have == want, "~=": lambda: want in have.split(), "^=": lambda: have.startswith(want), "$=": lambda: have.endswith(want), "*=": lambda: want in have}
            good = have is not None and tests[p["op"]]()
        if not good:
            return False
    return True


def _matches(e: Element, chain: list[tuple[str, list[dict]]]) -> bool:
    combinator, parts = chain[-1]
    if not _is(e, parts):
        return False
    if len(chain) == 1:
        return True
    above = e.parent
    while above is not None:
        if _matches(above, chain[:-1]):
            return True
        if combinator == ">":
            return False
        above = above.parent
    return False


def select(source: str, selector: str) -> list[Element]:
    """Elements that a selector names, in order."""
    chains = parsed(selector)
    return [e for e in _Reader(source).found if any(_matches(e, c) for c in chains)]


def value(source: str | None, selector: str | None, what: str = "text") -> str | None:
    """Trimmed text or inner HTML, or an attribute, of the first element that a selector names; null if there is none or it is empty."""
    if not source or not selector:
        return None
    for e in select(source, selector)[:1]:
        found = "".join(e.texts).strip() if what == "text" else source[e.start : e.end].strip() if what == "html" else e.attributes.get(what)
        return found or None
    return None


def selected(html: Column, selector: Column | str, what: str = "text") -> Column:
    """Column of ``value``; the selector may be a row's own."""

    @arrow_udf("string")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, names in batches:
            yield pa.array([value(x, s, what) for x, s in zip(pages.to_pylist(), names.to_pylist(), strict=True)], pa.string())

    return of(html, F.lit(selector) if isinstance(selector, str) else selector)


def contents(html: Column, selector: str) -> Column:
    """Column of array<string>: inner HTML of all elements that a selector names."""
    parsed(selector)

    @arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([[x[e.start : e.end] for e in select(x, selector)] if x else [] for x in arr.to_pylist()], pa.list_(pa.string()))

    return of(html)


def extractor(title: str, location: str | None = None, link: str | None = None):
    """For sources.files.landed: a struct of title, location and link by selectors; an absent one gives null."""

    def of(html: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(selected(html, title).alias("title"), (selected(html, location) if location else none).alias("location"), (selected(html, link, "href") if link else none).alias("link"))

    return of
