"""Boilerplate of postings: catalogs of patterns, tests for them and their removal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import needles
from millrace.functions import text as lines

#: Patterns of each category, in the order in which they are removed.
CATALOG: dict[str, list[str]] = {
    "legal_compliance": [r"(?i)required\s+qualifications(?:\s|$)", r"(?i)qualifications\s+experience", r"(?i)equal\s+opportunity", r"(?i)affirmative\s+action", r"(?i)fcra\s+disclosure", r"(?i)dbids", r"(?i)background\s+check", r"(?i)export\s+control", r"(?i)security\s+clearance", r"(?i)visa\s+sponsorship", r"(?i)compliance\s+requirements"],
    "section_headers": [r"(?i)\bjd\s*[:|-]", r"(?i)\bjob\s+description\s*[:|-]", r"(?i)\boverview\s*[:|-]", r"(?i)\brequirements\s*[:|-]", r"(?i)\bqualifications\s*[:|-]", r"(?i)\bresponsibilities\s*[:|-]", r"(?i)\bkey\s+responsibilities\s*[:|-]", r"(?i)\bwhat\s+you\s+will\s+do\s*[:|-]", r"(?i)\babout\s+the\s+role\s*[:|-]", r"(?i)\bskills\s*[:|-]", r"(?i)\btechnical\s+skills\s*[:|-]"],
    "company_boilerplate": [r"(?i)we\s+are\s+committed", r"(?i)we\s+believe", r"(?i)our\s+company\s+culture", r"(?i)about\s+\w+\s+(?:inc|ltd|corporation|company)", r"(?i)company\s+mission", r"(?i)our\s+mission", r"(?i)our\s+values", r"(?i)diversity\s+and\s+inclusion"],
    "time_references": [r"(?i)full[\s-]?time", r"(?i)part[\s-]?time", r"(?i)\bcontract\b(?!or|ing)", r"(?i)temporary", r"(?i)permanent", r"(?i)interim", r"(?i)shift\s+(?:work|position)"],
    "salary_benefits": [r"(?i)salary.*?(?:\$|year|hour|annually)", r"(?i)\$[\d,]+.*?(?:year|hour|annually)", r"(?i)(?:competitive\s+)?salary", r"(?i)(?:health|medical)\s+benefits", r"(?i)401\s*\(\s*k\s*\)", r"(?i)retirement\s+(?:plan|benefits)", r"(?i)(?:dental|vision|insurance)", r"(?i)(?:pto|paid\s+time\s+off|vacation)", r"(?i)(?:base\s+)?pay", r"(?i)compensation", r"(?i)stock\s+options?", r"(?i)bonus(?:es)?"],
    "special_formatting": [r"&nbsp;+", r"&amp;", r"&lt;|&gt;", r"&quot;", r"&#\d+;", r"\s{2,}", r"\n{2,}"],
    "navigation": [r"(?i)apply\s+now", r"(?i)share", r"(?i)save\s+job", r"(?i)next", r"(?i)previous", r"(?i)back\s+to\s+results", r"(?i)view\s+job", r"(?i)hide\s+details", r"(?i)show\s+more", r"(?i)read\s+more"],
}
#: Patterns that stand for white space: removed whole in the strict mode, else replaced by one space.
SPACES = (r"\s{2,}", r"\n{2,}")


def has_boilerplate(text: Column, category: str | None = None) -> Column:
    """Whether any pattern, or any of one category, is found; an unknown category has none."""
    patterns = [p for k, ps in CATALOG.items() if category in (None, k) for p in ps]
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(text, F.lit("")).rlike(p)
    return out


def without_boilerplate(text: Column, skip: tuple[str, ...] = (), glue: bool = False) -> Column:
    """Text after removing one pattern after another, in order; runs of white space become one space, with ``glue`` nothing."""
    steps = [(p, " " if p in SPACES and not glue else "") for category, patterns in CATALOG.items() if category not in skip for p in patterns]
    out = F.coalesce(text, F.lit(""))
    for i in range(0, len(steps), TOGETHER):
        out = lines.bound(out, _without(steps[i : i + TOGETHER]))
    return out


#: Patterns whose words are looked for together.
TOGETHER = 8


def _without(steps: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """A text without some patterns, one after another; as it is if it holds the words of none, as then none changes it for the next."""

    def changed(text: Column) -> Column:
        out = text
        for pattern, by in steps:
            out = F.regexp_replace(out, pattern, by)
        return out

    def where(text: Column, low: Column) -> Column:
        some = [needles.may(low, p) for p, _ in steps]
        if any(x is None for x in some):
            return changed(text)
        return F.when(reduce(lambda a, b: a | b, [x for x in some if x is not None]), changed(text)).otherwise(text)

    return lambda text: lines.bound(F.lower(text), lambda low: where(text, low))


#: Named character references that are decoded here.
NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}


def decoded(text: Column) -> Column:
    """Six named references decoded, other numeric ones taken out."""
    out = F.coalesce(text, F.lit(""))
    for k, v in NAMED.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(F.replace(out, F.lit("&amp;"), F.lit("&")), r"&#\d+;", "")


def single_spaced(text: Column) -> Column:
    """Spaces collapsed, three newlines or more made two, ends trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))
