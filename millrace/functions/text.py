"""Lines, bullets, Markdown and plain-text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that stand for headers, and marks of raw HTML.
HEADERS = (
    "qualifications", "desired qualifications", "preferred qualifications", "minimum qualifications", "essential qualifications",
    "requirements", "must-have", "must haves", "must-haves", "nice-to-have", "nice-to-haves", "nice to have", "nice to haves", "needed",
    "skills", "technical skills", "core skills", "competencies",
    "knowledge", "understanding",
    "responsibilities", "what you'll do", "duties", "accountabilities",
    "experience", "background",
    "education",
    "benefits", "compensation",
    "about the role", "about this role", "what we're looking for",
)
RAW_HTML = ("&lt;", "&gt;", "&amp;", "<html", "<div", "<p>", "<span", "<a href")
FOLDS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
BULLET = r"^\s*(?:[*+•-]|\d+[.)])\s+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is bound to a variable, so that it is derived once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is derived once a row, however many columns and filters name it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def joined(array: Column) -> Column:
    return F.array_join(array, "\n")


def each_line(text: Column, change: Callable[[Column], Column]) -> Column:
    return joined(F.transform(lines(text), change))


def is_raw_html(text: Column) -> Column:
    """Whether a text holds a mark of HTML; an empty one counts as raw."""
    def marked(low: Column) -> Column:
        out = F.btrim(low) == ""
        for mark in RAW_HTML:
            out = out | low.contains(mark)
        return out

    return bound(F.lower(F.coalesce(text, F.lit(""))), marked)


def without_references(html: Column) -> Column:
    """HTML without data and aria attributes, requirement references, orphan colons and empty pairs of tags."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"\s+(?:data|aria)-[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<dt\b[^>]*>", "<div>"), r"(?i)</dt>", "</div>")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<dd\b[^>]*>", "<p>"), r"(?i)</dd>", "</p>")
    out = F.regexp_replace(out, r":(?:\s*[Rr]\d+|\w+\d+|\d{4,})", "")
    out = F.regexp_replace(out, r">\s*:\s*<", "><")
    return F.regexp_replace(out, r"<(\w+)[^>]*>\s*</\1>", "")


def plain(html: Column) -> Column:
    """Text nodes of HTML without scripts, styles and comments; tags that end a block become newlines."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol|article|section|header|footer|nav|title)\s*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for k, v in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def tidy(text: Column) -> Column:
    """Lines trimmed, split at double spaces, blank ones and orphan references dropped."""
    pieces = F.flatten(F.transform(lines(text), lambda x: F.split(F.btrim(x), r" {2,}")))
    kept = F.filter(F.transform(pieces, lambda x: F.btrim(x)), lambda x: (x != "") & ~x.rlike(r"^(?:[Rr]\d+|\w+\d+)\s*$"))
    return joined(kept)


def bold_label(line: Column) -> Column:
    """Label of a line that is bold only; null for lists, headers, tables and numbered lines."""
    bare = F.btrim(F.replace(line, F.lit("\\*"), F.lit("*")))
    label = F.regexp_extract(bare, r"^\*\*([^*]+)\*\*:?$", 1)
    return F.when((label != "") & ~bare.rlike(r"^(?:[-+•#|]|\d+[.)])"), F.btrim(label))


def header_level(line: Column) -> Column:
    """1 to 3 for a Markdown header, -1 for a bold line, -2 for neither."""
    marks = F.length(F.regexp_extract(line, r"^(#{1,3})\s+\S", 1))
    return F.when(marks > 0, marks).when(bold_label(line).isNotNull(), -1).otherwise(-2)


def header_title(line: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_extract(line, r"^#{1,3}\s+(.*)$", 1)), F.lit("")), bold_label(line))


def keyword_headers(md: Column) -> Column:
    """Lines that are a known header phrase, bare or bold, become headers of level 2."""

    def bare(x: Column) -> Column:
        inner = F.regexp_extract(F.replace(F.btrim(x), F.lit("\\*"), F.lit("*")), r"^\*\*(.+?)\*\*$", 1)
        return F.btrim(F.regexp_replace(F.btrim(F.when(inner != "", inner).otherwise(F.btrim(x))), r":+$", ""))

    known = lambda x: F.lower(F.replace(bare(x), F.lit("’"), F.lit("'"))).isin(*HEADERS)
    return each_line(md, lambda x: F.when(known(x), F.concat(F.lit("## "), bare(x))).otherwise(x))


def bold_headers(md: Column) -> Column:
    """Lines that are bold, or start so, become headers of level 3 of the bold part if the next filled line is no header."""
    # what follows a line is looked at before any line is changed: a bold line is no header to the one before it
    out = F.regexp_replace(F.coalesce(md, F.lit("")), r"(?m)^[ \t]*\\\*\\\*(.+?)\\\*\\\*[ \t]*$", "**$1**")
    return F.regexp_replace(out, r"(?m)^[ \t]*\*\*[ \t]*(?!\*)([^*\n]+?)[ \t]*:?[ \t]*\*\*.*$(?=\s*\n\s*[^#\s])", "### $1")


def colon_headers(md: Column) -> Column:
    """Lines that end in a colon become headers of level 3."""
    ends = lambda x: F.btrim(x).rlike(r"^[^#*+\-•|>].*:$")
    return each_line(md, lambda x: F.when(ends(x), F.concat(F.lit("### "), F.regexp_replace(F.btrim(x), r":$", ""))).otherwise(x))


def divided(md: Column) -> Column:
    """A divider before each header of level 2 or 3 but the first line; repeated dividers once."""
    out = F.regexp_replace(md, r"(?m)(?<!\A)^(?=#{2,3}\s)", "\n---\n")
    return F.regexp_replace(out, r"(?m)(?:^---\n\s*)+^---$", "---")


def structured(md: Column) -> Column:
    return divided(colon_headers(bold_headers(keyword_headers(md))))


def bullets_plain(md: Column) -> Column:
    """Lines without list marks; those that had one end in a period."""
    marked = lambda x: x.rlike(BULLET)
    bare = lambda x: F.btrim(F.regexp_replace(x, BULLET, ""))
    return each_line(md, lambda x: F.when(marked(x), F.when(bare(x).rlike(r"[.!?:;]$"), bare(x)).otherwise(F.concat(bare(x), F.lit(".")))).otherwise(x))


def has_bullets(md: Column) -> Column:
    return F.coalesce(md, F.lit("")).rlike(rf"(?m){BULLET}")


def bullets(md: Column) -> Column:
    """List items with their indented continuation lines; other text ends an item."""
    marked = F.transform(lines(md), lambda x: F.when(x.rlike(BULLET), F.concat(F.lit("\x01"), F.btrim(F.regexp_replace(x, BULLET, "")))).when(F.btrim(x) == "", F.lit(None)).when(x.rlike(r"^\s+\S"), F.concat(F.lit("\x02"), F.btrim(x))).otherwise(F.lit("\x03")))
    # one text of items, each with what continues it; other lines end an item and hold nothing
    whole = F.regexp_replace(F.array_join(F.array_compact(marked), ""), "\x03\x02[^\x01\x03]*", "\x03")
    whole = F.regexp_replace(whole, "^\x02[^\x01\x03]*", "")
    found = F.filter(F.split(whole, "(?=[\x01\x03])"), lambda x: x.startswith("\x01"))
    return F.transform(found, lambda x: F.replace(F.substr(x, F.lit(2)), F.lit("\x02"), F.lit(" ")))


def without_emphasis(md: Column) -> Column:
    out = F.regexp_replace(F.coalesce(md, F.lit("")), r"\*\*(.+?)\*\*", "$1")
    out = F.regexp_replace(out, r"__(.+?)__", "$1")
    out = F.regexp_replace(out, r"\*(.+?)\*", "$1")
    return F.regexp_replace(out, r"_(.+?)_", "$1")


def folded(text: Column) -> Column:
    """Curly quotes, dashes and the ellipsis in plain characters."""
    return F.replace(F.translate(F.coalesce(text, F.lit("")), "".join(FOLDS), "".join(FOLDS.values())), F.lit("…"), F.lit("..."))


def two_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def normalized(md: Column) -> Column:
    return two_newlines(folded(without_emphasis(md)))


#: Rules of the polisher, in their order.
POLISH: dict[str, Callable[[Column], Column]] = {
    "strip_lines": lambda t: each_line(t, lambda x: F.rtrim(x)),
    "tighten_lists": lambda t: F.regexp_replace(t, r"(?m)(^\s*[-*+] .*)\n\n(?=\s*[-*+] )", "$1\n"),
    "pad_headers": lambda t: F.regexp_replace(F.regexp_replace(t, r"(?m)(?<!\n\n)(?<!\A)^(#{1,6} .*)$", "\n$1"), r"(?m)^(#{1,6} .*)\n(?!\n)", "$1\n\n"),
    "separate_lists": lambda t: F.regexp_replace(t, r"(?m)^(?!\s*[-*+] )(?!#)(\S.*)\n(?=\s*[-*+] )", "$1\n\n"),
    "collapse_newlines": two_newlines,
}


def polished(md: Column, rules: Iterable[str] | None = None) -> Column:
    """Markdown after some or all rules of the polisher; an unknown rule is an error."""
    chosen = list(POLISH) if rules is None else list(rules)
    unknown = set(chosen) - set(POLISH)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    out = F.coalesce(md, F.lit(""))
    for name in chosen:
        out = POLISH[name](out)
    return out


def sections(md: Column) -> Column:
    """Texts between headers of level 1 to 3 or bold lines."""
    parts = F.split(F.coalesce(md, F.lit("")), r"(?m)(?=^(?:#{1,3}\s|\*\*.+\*\*\s*$))")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \n"))), lambda x: x != "")


def without_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """Lines that hold none of some phrases."""
    low = [p.lower() for p in phrases]

    def clean(x: Column) -> Column:
        out = F.lit(True)
        for p in low:
            out = out & ~x.contains(p)
        return out

    return joined(F.filter(lines(text), lambda x: bound(F.lower(x), clean)))


#: Abbreviations after which a sentence goes on (fixed values).
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "Mr", "Mrs", "Ms", "Dr", "Inc", "Ltd", "Co", "No", "approx")


def sentences(text: Column) -> Column:
    """Sentences by rule: they end at . ! or ? before white space, unless an abbreviation stands there, and at newlines."""
    guard = "".join(rf"(?<!\b{a.replace('.', chr(92) + '.')}\.)" for a in ABBREVIATIONS)
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?]){guard}\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: x != "")


def clean_description(html: Column, skip: tuple[str, ...] = ()) -> Column:
    """Plain, single-spaced text of a posting's HTML without boilerplate."""
    from millrace.functions import boilerplate

    return boilerplate.single_spaced(boilerplate.decoded(boilerplate.without_boilerplate(plain(without_references(html)), skip)))


def posting_text(title: Column, location: Column, description: Column) -> Column:
    """Title, location and cleaned description, one to a line; absent ones are passed over."""
    filled = lambda x: bound(x, lambda y: F.nullif(y, F.lit("")))
    return F.concat_ws("\n", filled(title), filled(location), filled(clean_description(description)))
