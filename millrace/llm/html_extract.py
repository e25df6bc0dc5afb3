"""Main text of pages by wrappers: union-free regular expressions inferred from a host's pages.

Each page becomes a stream of tags and text. Its canonical form folds runs of equal sibling groups into one repeated
group and every text into a slot, which counts its texts, their words, those in links, and sketches how many different
texts it has (the least hashes). Equal forms of a host are added up; aligning the distinct ones, in an order of their
own, leaves the host's wrapper: equal parts stay, a mismatch of text is a slot, a part that only some pages have becomes
optional, and a part that some pages have several times becomes repeated. Forms meet by host and form, then by host and
hash of the form, then by host, so that no task gathers a host's pages and the result doesn't depend on how they are dealt.

The wrapper decides what is main. Slots that say the same on nearly all pages are template; what is left, without links
and regions that are by tag not main, is a host's variable text. From its article, main or body the region is narrowed
to the one part that holds most of it. Within the region, parts that are template, lists of links, or by tag or name
menus, adverts, forms, notices or comments are left out; variable headings beside the region on the way up belong to it.
Extraction aligns a page's own elements with the wrapper, part by part, and keeps the text of those that fall into the
region. A page that has no part of it is judged by the wrapper of its own form.

Defined results: a null or empty html, or one without text, gives an empty text of 0 characters; an unfinished tag at the end
is dropped, an unfinished character reference is text; a null or hostless url stands as a host of its own name; repeated
pages are extracted alike, and copies of a page don't make its text a template; extra columns pass through unless the
result has their name.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.llm.common import bounded_batches, byte_slices, checkpointed
from millrace.llm.url_filter import host_of

#: HTML's elements by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", *RAW}
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold regions of a page.
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td", "ul", "ol", "dl", "header", "details"}
#: A class, id or role, as a whole, of regions that aren't main text.
ASIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Elements nest so deep; deeper ones stand side by side.
DEEPEST = 100
#: Least hashes that a slot keeps of its texts.
SKETCH = 16
#: A slot is template if its different texts are at most this share of its texts, beside the share of different pages; of so many pages at least.
TEMPLATE, LEAST_PAGES = 0.2, 5
#: A part is gone into if it holds so much of the variable text; a region of so many links to a page, and so much of its words in them, is a list of links.
MOST, LINKS, LINKED = 0.7, 3, 0.5
#: Forms that a task holds before it passes them on; groups by task, and by hash of the form, in which forms are merged.
HELD, DEALT, SALTS = 2000, 256, 16
#: Wrappers of so many bytes in all are broadcast.
BROADCAST_BYTES = 16 << 20
RESULT = ["text", "n_chars"]

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</\s*([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NUMBER = re.compile(r"[-_]*\d+")
_SPACE = re.compile(r"\s+")

#: A stream's items: ("<", tag with its names), (">", tag) and ("t", text).
Item = tuple[str, str]


def stream(page: str) -> list[Item]:
    """Tags and texts of a page, balanced: elements that the page leaves open are closed where they must end."""
    out: list[Item] = []
    opened: list[str] = []
    at = 0
    while at < len(page):
        m = _PART.match(page, at)
        if m is None:  # a tag with an open quotation up to the end
            at = page.find(">", at) + 1 or len(page)
            continue
        at = m.end()
        data, closing, opening, attributes, end, text = m.groups()
        if text is not None or data is not None:
            out.append(("t", text if text is not None else data))
        elif closing:
            name = closing.lower()
            if name in opened:
                while opened:
                    last = opened.pop()
                    out.append((">", last))
                    if last == name:
                        break
        elif opening:
            name = opening.lower()
            if not end:
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
                continue
            if name in CLOSES or name in BLOCK:
                shut = CLOSES.get(name, {"p"} if name in BLOCK else set())
                depth = len(opened)
                while depth and opened[depth - 1] not in BLOCK:
                    depth -= 1
                if depth and opened[depth - 1] in shut:
                    while len(opened) >= depth:
                        out.append((">", opened.pop()))
            if len(opened) >= DEEPEST:
                out.append((">", opened.pop()))
            named = _label(name, attributes or "")
            out.append(("<", named))
            if name in VOID:
                out.append((">", name))
            else:
                opened.append(name)
    while opened:
        out.append((">", opened.pop()))
    return out


def _label(name: str, attributes: str) -> str:
    """Tag with its classes, id and role; numbers in them don't tell elements apart."""
    found = (_NUMBER.sub("", w.lower()) for m in _ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").split())
    words = sorted({w.replace(".", "_") for w in found if w})
    return f"{name}.{'.'.join(words)}" if words else name


# A form is a list of nodes: ["#", counts] a slot; [label, [nodes]] an element; ["+", [nodes]] repeated; ["?", [nodes]] optional.
# A slot's counts: pages, texts, words, words in links, texts in links, least hashes of its texts.


def slot(text: str, linked: bool) -> list:
    words = len(text.split())
    return ["#", [1, 1, words, words * linked, int(linked), [zlib.crc32(text.strip().encode())]]]


def _added(one: list, two: list, same_page: bool) -> list:
    """Counts of two slots that are one."""
    pages = max(one[0], two[0]) if same_page else one[0] + two[0]
    return [pages, *(x + y for x, y in zip(one[1:5], two[1:5], strict=True)), sorted({*one[5], *two[5]})[:SKETCH]]


def combined(one: list, two: list, same_page: bool = False) -> list:
    """Two forms of equal structure as one with the counts of both."""
    return [[a[0], _added(a[1], b[1], same_page) if a[0] == "#" else combined(a[1], b[1], same_page)] for a, b in zip(one, two, strict=True)]


def structure(nodes: list) -> str:
    return "".join("#" if x[0] == "#" else f"{x[0]}({structure(x[1])})" for x in nodes)


def form(items: list[Item]) -> list:
    """Canonical form of a stream."""
    root: list = []
    keys: list[list[str]] = [[]]
    stack = [root]
    opened: list[str] = []
    for kind, value in items:
        if kind == "<":
            node = [value, []]
            stack[-1].append(node)
            stack.append(node[1])
            keys.append([])
            opened.append(value.split(".")[0])
        elif kind == ">":
            done, own = stack.pop(), keys.pop()
            done[:], own = folded(done, own)
            keys[-1].append(f"{stack[-1][-1][0]}({''.join(own)})")
            opened.pop()
        elif value.strip():
            new = slot(value, "a" in opened)
            if stack[-1] and stack[-1][-1][0] == "#":
                stack[-1][-1][1] = _added(stack[-1][-1][1], new[1], True)
            else:
                stack[-1].append(new)
                keys[-1].append("#")
    return folded(root, keys[-1])[0]


def folded(nodes: list, keys: list[str], widest: int = 4) -> tuple[list, list[str]]:
    """Neighbouring equal groups of 1 to ``widest`` nodes as one repeated group; ``keys`` are the nodes' structures."""
    nodes, keys = list(nodes), list(keys)
    for width in range(1, widest + 1):
        at = 0
        while at + 2 * width <= len(nodes):
            if keys[at : at + width] != keys[at + width : at + 2 * width]:
                at += 1
                continue
            group, own, stop = nodes[at : at + width], keys[at : at + width], at + width
            while keys[stop : stop + width] == own:
                group = combined(group, nodes[stop : stop + width], True)
                stop += width
            inner = group[0][1] if width == 1 and group[0][0] == "+" else group
            key = own[0] if width == 1 and group[0][0] == "+" else f"+({''.join(own)})"
            nodes[at:stop], keys[at:stop] = [["+", inner]], [key]
            at += 1
    return nodes, keys


def aligned(one: list, two: list) -> list:
    """The least general union-free form that matches what either matches."""
    n, m = len(one), len(two)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + _likeness(one[i], two[j]))
    out: list = []
    i = j = 0
    while i < n and j < m:
        like = _likeness(one[i], two[j])
        if like and best[i][j] == best[i + 1][j + 1] + like:
            out.append(_merged(one[i], two[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append(_optional(one[i]))
            i += 1
        else:
            out.append(_optional(two[j]))
            j += 1
    out += [_optional(x) for x in one[i:]] + [_optional(x) for x in two[j:]]
    return _closed(out)


def _core(node: list) -> list:
    """What a repeated or optional group holds; a node by itself."""
    while node[0] in ("+", "?"):
        if len(node[1]) != 1:
            return node[1]
        node = node[1][0]
    return [node]


def _inside(nodes: list) -> set[str]:
    """Labels of the elements and slots right in some nodes, through groups."""
    return {y for x in nodes for y in (_inside(x[1]) if x[0] in ("+", "?") else (x[0],))}


def _alike(one: set[str], two: set[str]) -> float:
    return len(one & two) / len(one | two) if one or two else 1.0


def _likeness(a: list, b: list) -> float:
    x, y = _core(a), _core(b)
    if len(x) != len(y) or any(p[0] != q[0] for p, q in zip(x, y, strict=True)):
        return 0.0
    return 2.0 + sum(1.0 if p[0] == "#" else _alike(_inside(p[1]), _inside(q[1])) for p, q in zip(x, y, strict=True)) / len(x)


def _merged(a: list, b: list) -> list:
    inner = [[p[0], _added(p[1], q[1], False) if p[0] == "#" else aligned(p[1], q[1])] for p, q in zip(_core(a), _core(b), strict=True)]
    marks = {k for node in (a, b) for k in _marks(node)}
    if "+" in marks:
        inner = [["+", inner]]
    if "?" in marks:
        inner = [["?", inner]]
    return inner[0] if len(inner) == 1 else ["+", inner]


def _marks(node: list) -> Iterator[str]:
    while node[0] in ("+", "?"):
        yield node[0]
        if len(node[1]) != 1:
            return
        node = node[1][0]


def _optional(node: list) -> list:
    return node if node[0] == "?" else ["?", [node]]


def _closed(nodes: list) -> list:
    """Optional neighbours of the same kind and content as a repeated or single one beside them are taken into it."""
    out: list = []
    for node in nodes:
        if out and (node[0] == "?" or out[-1][0] == "?") and _likeness(out[-1], node) == 3:
            inner = _core(_merged(out[-1], node))
            need = out[-1][0] != "?" or node[0] != "?"
            out[-1] = ["+", inner] if need else ["?", [["+", inner]]]
        else:
            out.append(node)
    return out


def union_of(forms: Iterable[str]) -> str:
    """The wrapper of serialised forms [pages, form], in an order of their own; equal forms are added up first."""
    whole: dict[str, list] = {}
    for pages, nodes in map(json.loads, sorted(forms)):
        key = structure(nodes)
        old = whole.get(key)
        whole[key] = [_added(old[0], pages, False), combined(old[1], nodes)] if old else [pages, nodes]
    (_, (pages, wrapper)), *others = sorted(whole.items(), key=lambda x: (len(x[0]), x[0]))
    for _, (more, nodes) in others:
        pages, wrapper = _added(pages, more, False), aligned(wrapper, nodes)
    return dumps([pages, wrapper])


def dumps(nodes: list) -> str:
    return json.dumps(nodes, separators=(",", ":"), ensure_ascii=False)


def different(counts: list) -> float:
    """Estimated number of different texts of a slot."""
    least = counts[5]
    return len(least) if len(least) < SKETCH else (SKETCH - 1) * 2**32 / max(1, least[-1])


class Part:
    """An element of a wrapper, with the parts in it, each one's loop (parts of one repeated group share one), and sums of
    their slots; ``main`` after the wrapper has decided."""

    def __init__(self, label: str, nodes: list, template, looped: bool = False):
        self.label, self.looped = label, looped
        self.tag, *names = label.split(".")
        self.named = self.tag in CONTAINERS | {"span"} and not ASIDE_NAMES.isdisjoint(names)
        self.kids: list[Part] = []
        self.loops: list[int] = []
        self.inside = _inside(nodes)
        self.main = False
        self.own = self.words = self.fixed = self.linked = self.links = self.pages = 0
        self._take(nodes, -1, template)
        for kid in self.kids:
            self.words, self.fixed, self.linked, self.links = self.words + kid.words, self.fixed + kid.fixed, self.linked + kid.linked, self.links + kid.links
            self.pages = max(self.pages, kid.pages)
        self.mass = 0 if self.aside() else self.own + sum(kid.mass for kid in self.kids)

    def _take(self, nodes: list, loop: int, template) -> None:
        for x in nodes:
            if x[0] == "#":
                pages, _, words, linked, links, _ = x[1]
                fixed = words * template(x[1])
                self.own += 0 if fixed else words - linked
                self.words, self.fixed, self.linked, self.links = self.words + words, self.fixed + fixed, self.linked + linked, self.links + links
                self.pages = max(self.pages, pages)
            elif x[0] in ("+", "?"):
                self._take(x[1], len(self.kids) if x[0] == "+" and loop < 0 else loop, template)
            else:
                self.kids.append(Part(x[0], x[1], template, loop >= 0))
                self.loops.append(loop)

    def heading(self) -> bool:
        return self.tag in HEADINGS and not self.template() or any(k.heading() for k in self.kids)

    def template(self) -> bool:
        return self.words > 0 and self.fixed >= 0.9 * self.words

    def aside(self) -> bool:
        """Whether the part, for itself, isn't main."""
        if self.tag in ASIDE_TAGS and not (self.tag == "header" and self.heading()) or self.named:
            return True
        if self.tag in BLOCK and self.template():
            return True
        return self.tag in CONTAINERS and self.linked > LINKED * self.words and self.links >= LINKS * self.pages

    def take(self) -> None:
        """Makes the part main, without what in it isn't."""
        self.main = True
        for kid in self.kids:
            if not kid.aside():
                kid.take()


class Wrapper:
    """A host's wrapper, which says of each part whether it is main."""

    def __init__(self, nodes: list, pages: list | None = None):
        pages = pages or [1, 1, 0, 0, 0, [0]]
        shared = different(pages) / max(1, pages[1])  # the share of different pages
        many = different(pages) >= LEAST_PAGES
        self.root = Part("", nodes, lambda c: many and c[0] >= LEAST_PAGES and different(c) <= TEMPLATE * shared * c[1])
        self._decide()

    def _decide(self) -> None:
        if not self.root.kids:
            return
        path = self._to_article()
        while True:
            part = path[-1]
            if part.tag == "article" or part.tag == "main" and len(path) > 1:
                break
            kids = [k for k in part.kids if k.mass and not k.looped and k.tag in CONTAINERS]
            if sum(k.tag == "article" for k in kids) > 1:
                break
            best = max(kids, key=lambda k: k.mass, default=None)
            if best is None or best.mass < MOST * part.mass:
                break
            path.append(best)
        path[-1].take()
        for above, part in zip(path[-2::-1], path[:0:-1], strict=True):
            if part.tag in ("article", "main", "body"):
                break
            for kid in above.kids:
                if kid is not part and kid.mass and not kid.looped and (kid.tag in HEADINGS or kid.tag in CONTAINERS and kid.heading() and kid.mass < part.mass / 4):
                    kid.take()

    def _to_article(self) -> list[Part]:
        """The path to the one article, else main, that holds a good part of the variable text; else to the root."""
        for tag in ("article", "main"):
            found = list(self._paths(self.root, tag))
            if len(found) == 1 and found[0][-1].mass >= (1 - MOST) * self.root.mass and (found[0][-1].mass or not self.root.mass):
                return found[0]
        return [self.root]

    def _paths(self, part: Part, tag: str) -> Iterator[list[Part]]:
        for kid in part.kids:
            if kid.aside():
                continue
            if kid.tag == tag:
                # one of several, which together are the region, is no region itself
                yield from [[part, kid]] * (1 + kid.looped)
            else:
                for path in self._paths(kid, tag):
                    yield [part, *path]


def matched(part: Part, labels: list[str], insides: list[set[str]]) -> list[Part | None]:
    """For elements of a page the parts of ``part`` that they are, in order: most in number, then most alike. Elements may
    repeat a loop's parts; any part may be left out."""
    kids, loops = part.kids, part.loops
    n = len(kids)
    if not n:
        return [None] * len(labels)
    best = [0.0] * (n + 1)  # by 1 + the last part that is used
    back: list[list[tuple[int, int]]] = []
    for label, inside in zip(labels, insides, strict=True):
        new, how = list(best), [(j, -1) for j in range(n + 1)]
        high, at = best[0], 0
        for j in range(n):
            # best over earlier parts, and over later ones of the same loop
            if kids[j].label == label:
                value, source = high, at
                if loops[j] >= 0:
                    for i in range(j, n):
                        if loops[i] == loops[j] and best[i + 1] > value:
                            value, source = best[i + 1], i + 1
                value += 2.0 + _alike(inside, kids[j].inside)
                if value > new[j + 1]:
                    new[j + 1], how[j + 1] = value, (source, j)
            if best[j + 1] > high:
                high, at = best[j + 1], j + 1
        best = new
        back.append(how)
    out: list[Part | None] = []
    j = max(range(n + 1), key=best.__getitem__)
    for how in reversed(back):
        j, used = how[j]
        out.append(kids[used] if used >= 0 else None)
    return out[::-1]


class Element:
    """An element of a page: its label, and what is in it."""

    __slots__ = ("label", "kids")

    def __init__(self, label: str):
        self.label = label
        self.kids: list[Element | str] = []

    def inside(self) -> set[str]:
        return {"#" if isinstance(x, str) else x.label for x in self.kids if not isinstance(x, str) or x.strip()}


def element(items: list[Item]) -> Element:
    """A stream as one element."""
    stack = [Element("")]
    for kind, value in items:
        if kind == "<":
            new = Element(value)
            stack[-1].kids.append(new)
            stack.append(new)
        elif kind == ">":
            stack.pop()
        else:
            stack[-1].kids.append(value)
    return stack[0]


def main_text(items: list[Item], wrapper: Wrapper) -> str:
    """Blocks of a page's main text, one line each."""
    page = element(items)
    blocks, found = _blocks(page, wrapper.root)
    if not found:
        blocks, _ = _blocks(page, Wrapper(form(items)).root)
    return "\n".join(blocks)


def _blocks(page: Element, root: Part) -> tuple[list[str], bool]:
    """Main blocks under a wrapper, and whether the page has any main part."""
    blocks: list[str] = []
    pieces: list[str] = []
    found = False

    def flush() -> None:
        if pieces:
            if text := _SPACE.sub(" ", entities.unescape("".join(pieces))).strip():
                blocks.append(text)
            pieces.clear()

    # (element, its part or none, whether it is main), or an end of a block; no recursion, as pages nest without bound
    todo: list[tuple[Element | str | None, Part | None, bool]] = [(page, root, root.main)]
    while todo:
        node, part, main = todo.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            if main:
                pieces.append(node)
            continue
        tag = node.label.split(".")[0]
        found = found or main
        if tag in BLOCK:
            flush()
            todo.append((None, None, False))
        elif tag == "br":
            pieces.append(" ")
        if not node.kids:
            continue
        elements = [x for x in node.kids if not isinstance(x, str)]
        parts = iter(matched(part, [x.label for x in elements], [x.inside() for x in elements]) if part and elements else [None] * len(elements))
        below: list[tuple[Element | str | None, Part | None, bool]] = []
        for x in node.kids:
            if isinstance(x, str):
                below.append((x, None, main))
                continue
            own = next(parts)
            below.append((x, own, own.main if own else main and not Part(x.label, [[y, []] for y in x.inside() - {"#"}], bool).aside()))
        todo += reversed(below)
    flush()
    return blocks, found


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) of all pages; host is the empty string where there is none."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list] = {}
        dealt = TaskContext.get().partitionId() % DEALT

        def rows() -> Iterator[pa.RecordBatch]:
            for k, items in enumerate(_pieces(list(seen.items()), 500)):
                columns = [[h for (h, _), _ in items], [zlib.crc32(s.encode()) for (_, s), _ in items], [dealt] * len(items), [dumps(x) for _, x in items]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["host", "key", "dealt", "form"])

        for batch in batches:
            hosts, at = batch.column(0).to_pylist(), 0
            for part in byte_slices(batch.column(1)):
                for page in part:
                    nodes = form(stream(page.decode("utf-8", "replace")))
                    key, one = (hosts[at], structure(nodes)), [1, 1, 0, 0, 0, [zlib.crc32(page)]]
                    old = seen.get(key)
                    seen[key] = [_added(old[0], one, False), combined(old[1], nodes)] if old else [one, nodes]
                    at += 1
                if len(seen) >= HELD:
                    yield from rows()
                    seen = {}
        yield from rows()

    @arrow_udf("string")
    def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([union_of(x) for x in arr.to_pylist()], pa.string())

    host = F.coalesce(host_of(F.col(url)), F.lit(""))
    found = pages.select(host.alias("host"), F.col(html).alias("html")).mapInArrow(forms, "host string, key long, dealt int, form string")
    def met(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.collect_list("form").alias("forms")).select(*keys, merged("forms").alias("form"))

    # equal forms are added up, then different ones aligned
    found = met(met(found, "host", "key", "dealt"), "host", "key")
    found = met(met(found.withColumn("key", F.col("key") % SALTS), "host", "key"), "host")
    return found.select("host", F.col("form").alias("wrapper"))


def _pieces(x: list, n: int) -> Iterator[list]:
    for at in range(0, len(x), n):
        yield x[at : at + n]


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points)."""
    bounded_batches(pages.sparkSession)

    @arrow_udf("string")
    def text_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, Wrapper] = {}
        for page, wrapper in batches:
            out, names, at = [], wrapper.to_pylist(), 0
            for part in byte_slices(page):
                for data in part:
                    name = names[at] or "[null,[]]"
                    if name not in known:
                        if len(known) > 5000:
                            known.clear()
                        pages, nodes = json.loads(name)
                        known[name] = Wrapper(nodes, pages)
                    out.append(main_text(stream(data.decode("utf-8", "replace")), known[name]))
                    at += 1
            yield pa.array(out, pa.string())

    names = [c for c in pages.columns if c not in RESULT]
    hosted = pages.withColumn("_host", F.coalesce(host_of(F.col(url)), F.lit("")))
    known = checkpointed(wrappers(pages, url, html).withColumnRenamed("host", "_host"))
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("_host"))).first()[0] or 0
    # beyond the bound the pages meet their wrappers in a shuffle, whose hot hosts are split at run time
    found = hosted.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "_host", "left")
    made = found.select(*[F.col(f"`{c}`") for c in names], text_of(F.col(f"`{html}`"), F.col("wrapper")).alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("long"))
