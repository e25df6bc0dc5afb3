"""Words without which a pattern can't match: a search for them is far cheaper than the pattern's own."""

from __future__ import annotations

import re
from functools import cache, reduce
from re import _constants as ops  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A text, or "and" or "or" before such needs.
Need = str | tuple


@cache
def needs(pattern: str) -> Need | None:
    """What every match of a pattern, lower-cased, holds, as ASCII texts in lower case; None where nothing can be told."""
    bare = re.sub(r"^(?:\(\?[a-zA-Z]+\))+", "", pattern)
    try:
        return _of(list(_parser.parse(bare)))
    except (re.error, RecursionError):
        return None


def _joined(kind: str, parts: list[Need]) -> Need:
    once = list(dict.fromkeys(parts))
    return once[0] if len(once) == 1 else (kind, *once)


def _of(parts: list) -> Need | None:
    held: list[Need] = []
    run = ""
    for op, arg in [*parts, (None, None)]:
        if op is ops.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run.strip():
            held.append(run)
        run = ""
        inner = None
        if op is ops.SUBPATTERN:
            inner = _of(list(arg[-1]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] > 0:
            inner = _of(list(arg[2]))
        elif op is ops.BRANCH:
            each = [_of(list(x)) for x in arg[1]]
            inner = None if any(x is None for x in each) else _joined("or", [x for x in each if x is not None])
        if inner is not None:
            held.append(inner)
    # longer texts say more and are asked for first; single letters say little
    told = [x for x in held if not (isinstance(x, str) and len(x) == 1)] or held
    return _joined("and", sorted(told, key=lambda x: -len(x) if isinstance(x, str) else 0)) if told else None


def _holds(low: Column, need: Need) -> Column:
    if isinstance(need, str):
        return low.contains(need)
    kind, *parts = need
    return reduce(lambda a, b: a & b if kind == "and" else a | b, [_holds(low, x) for x in parts])


def may(low: Column, pattern: str) -> Column | None:
    """Whether a lower-cased text holds what a pattern needs; None where nothing is known to be needed."""
    need = needs(pattern)
    return None if need is None else _holds(low, need)


def found(text: Column, low: Column, pattern: str) -> Column:
    """As ``text.rlike(pattern)``; ``low`` is the text in lower case."""
    first = may(low, pattern)
    return text.rlike(pattern) if first is None else first & text.rlike(pattern)


def extracted(text: Column, low: Column, pattern: str, group: int) -> Column:
    """As ``regexp_extract`` of a text that isn't null."""
    first = may(low, pattern)
    out = F.regexp_extract(text, pattern, group)
    return out if first is None else F.when(first, out).otherwise("")


def extracted_all(text: Column, low: Column, pattern: str, group: int) -> Column:
    """As ``regexp_extract_all`` of a text that isn't null."""
    first = may(low, pattern)
    out = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return out if first is None else F.when(first, out).otherwise(F.array().cast("array<string>"))
