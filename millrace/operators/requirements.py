"""Requirements in postings: trigger patterns, their confidence, sections and spans.

Sentences are split by rule and closed lists of words stand for parts of speech; parity with a statistical model is not
claimed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.functions import needles, scalars, text
from millrace.operators import similarity

#: Trigger, pattern and confidence of requirement phrases.
PHRASES = [
    ("required", r"(required[\w\s\-]*)", 0.95),
    ("must", r"(must\s+(?:have\s+)?[\w\s\-]+)", 0.93),
    ("essential", r"(essential[\w\s\-]*)", 0.90),
    ("ability to", r"(ability\s+to\s+[\w\s\-]+)", 0.92),
    ("experience in", r"((?:experience|background)\s+(?:with|in)\s+[\w\s\-\.]+)", 0.88),
    ("proficiency", r"(proficiency\s+(?:in|with)?\s+[\w\s\-\.]+)", 0.91),
    ("knowledge of", r"(knowledge\s+of\s+[\w\s\-\.]+)", 0.85),
    ("understanding of", r"(understanding\s+of\s+[\w\s\-\.]+)", 0.83),
    ("should", r"(should\s+(?:have\s+)?[\w\s\-]+)", 0.70),
    ("prefer", r"((?:preferred|prefer)[\w\s\-:]*)", 0.65),
    ("degree", r"((?:bachelor's?|master's?|phd)\s+(?:degree\s*)?(?:in|of)?\s*[\w\s\-]*)", 0.89),
    ("years of", r"([\d\+]+\s+years?\s+(?:of|in)\s+[\w\s\-]+)", 0.80),
    ("nice to have", r"(nice\s+to\s+have\s+[\w\s\-]+)", 0.40),
    ("ideal", r"(ideal[\w\s\-]*)", 0.55),
    ("bonus", r"(bonus[\w\s\-:]*)", 0.45),
]
#: Trigger, pattern, confidence and priority of sentences.
TRIGGERS = [
    ("required", r"\brequired\b", 0.95, 1),
    ("must", r"\bmust\s+(?:have|be|possess|know|understand)", 0.93, 1),
    ("essential", r"\bessential\b", 0.90, 1),
    ("mandatory", r"\bmandatory\b", 0.92, 1),
    ("ability to", r"\bability\s+to\b", 0.92, 1),
    ("experience with", r"\b(?:experience|background)\s+(?:with|in)\b", 0.88, 1),
    ("proficiency", r"\bproficiency\b", 0.91, 1),
    ("knowledge of", r"\bknowledge\s+of\b", 0.85, 1),
    ("understanding of", r"\bunderstanding\s+of\b", 0.83, 1),
    ("should", r"\bshould\s+(?:have|know|be|possess)", 0.70, 2),
    ("prefer", r"\b(?:prefer|preferred)\b", 0.65, 2),
    ("bachelor's degree", r"\b(?:bachelor's?|master's?|phd)\s+(?:degree|in)\b", 0.89, 2),
    ("years of", r"\b(\d+\+?)\s+years?\s+(?:of|in)\b", 0.80, 2),
    ("nice to have", r"\bnice\s+to\s+have\b", 0.40, 3),
    ("ideal", r"\bideal\b", 0.55, 3),
    ("bonus", r"\bbonus\b", 0.45, 3),
    ("years_in_bullet", r"\b(\d+\+?)\s+years?\b", 0.85, 2),
    ("ability_in_bullet", r"\bability\b", 0.90, 1),
    ("required_prefix", r"\brequired\b", 0.95, 1),
    ("degree_in_bullet", r"\b(?:bachelor's?|master's?|phd|degree)\b", 0.92, 2),
    ("degree abbreviation", r"\b(?:BS\+|MS\+|BA\+|MA\+|BS|MS|BA|MA|PhD)\b", 0.89, 2),
    ("degree", r"\b(?:bachelor's?|master's?|phd|bs|ms|ba|ma)\s+(?:degree|in|of)?\b", 0.89, 2),
    ("certification", r"\b(?:certified?|certification)\s+(?:in|by)?\b", 0.80, 2),
    ("qualified in", r"\b(?:qualified|qualification)\s+(?:in|with)\b", 0.78, 2),
    ("on-site location", r"\b(?:on-site|on site|office|in-office|remote|hybrid|office-based)\b", 0.85, 2),
    ("location based", r"\b(?:location|based\s+in|located\s+in|work\s+(?:from|in))\b", 0.75, 2),
    ("communication skills", r"\b(?:communicat(?:e|ion|or)|written|verbal|presentation)\s+(?:skills?|abilities?)\b", 0.82, 2),
    ("leadership mentoring", r"\b(?:leadership|mentor(?:ing)?|team\s+lead|technical\s+lead)\b", 0.81, 2),
    ("teamwork collaboration", r"\b(?:teamwork|collaboration|collaborat(?:e|ive)|cross-functional|team\s+player)\b", 0.79, 2),
    ("strong attribute", r"\bstrong\s+(?:experience|understanding|expertise|ability|skills?|background)\b", 0.76, 2),
]
#: Section labels with the pattern of their header, what they add to a confidence, and whether requirements are taken from them.
SECTIONS = [
    ("KNOWLEDGE_SKILLS", r"knowledge,?\s+skills\s+(?:&|and)\s+abilities", 0.12, True),
    ("IN_OFFICE", r"in\s+office\s+(?:requirements|location)", 0.08, True),
    ("WHAT_YOU_DO", r"what\s+you(?:'ll|\s+will)?\s+do", -0.05, True),
    ("TECHNICAL_SKILLS", r"technical\s+skills", 0.12, True),
    ("PREFERRED_SKILLS", r"preferred(?:\s+skills)?", -0.15, True),
    ("NICE_TO_HAVE", r"nice\s+to\s+have", -0.25, True),
    ("REQUIREMENTS", r"requirements", 0.15, True),
    ("QUALIFICATIONS", r"qualifications", 0.10, True),
    ("EDUCATION", r"education", 0.05, True),
    ("EXPERIENCE", r"(?:required\s+)?(?:professional\s+)?experience", 0.08, True),
    ("BENEFITS", r"benefits", -0.50, False),
    ("COMPENSATION", r"salary|compensation|pay", -0.50, False),
    ("HIRING_PROCESS", r"hiring|application|process", -0.50, False),
]
#: Negations, before or after a trigger.
NEGATED = r"(?i)\b(?:not|no|never|without|isn't|aren't|doesn't|don't|won't)\b"
ARTICLES = {"the", "a", "an", "this", "that", "these", "those", "any", "some"}
SUBORDINATORS = {"if", "unless", "because"}
NEAR = 50


def adjusted(base: Column, sentence: Column, at: Column) -> Column:
    """Confidence of a match at a place (from 1) of a sentence: 0 if negated nearby, less for conditions and wishes."""
    window = F.substring(sentence, F.greatest(at - NEAR, F.lit(1)), F.lit(2 * NEAR + 20))
    out = base - F.when(sentence.contains("("), 0.10).otherwise(0.0) - F.when(sentence.rlike(r"(?i)\bif\b"), 0.15).otherwise(0.0) - F.when(sentence.rlike(r"(?i)nice\s+to\s+have"), 0.25).otherwise(0.0)
    out = out + F.when(F.regexp_count(sentence, F.lit(r"\b[A-Z]{2,}\b")) > 2, 0.05).otherwise(0.0)
    return F.when(window.rlike(NEGATED), 0.0).otherwise(scalars.clamp(out))


def classified(sentence: Column) -> Column:
    """Struct (trigger, confidence, priority) of the best trigger of a sentence, by priority and confidence; null for none or a negated one."""
    # in order of rank, so that the search ends at the first one that is there
    def ranked(low: Column) -> Column:
        best = F.when(F.lit(False), F.lit(None))
        for t, p, c, k in sorted(TRIGGERS, key=lambda x: (x[3], -x[2])):
            best = best.when(needles.found(sentence, low, f"(?i){p}"), F.struct(F.lit(k).alias("priority"), F.lit(c).alias("base"), F.lit(t).alias("trigger"), F.regexp_instr(sentence, F.lit(f"(?i){p}")).alias("at")))
        return best

    best = text.bound(F.lower(sentence), ranked)

    # the best candidate is bound to a variable of a function, so that its search runs once however often it is named
    def verdict(x: Column) -> Column:
        confidence = F.round(adjusted(x["base"], sentence, x["at"]), 3)
        return F.struct(x["trigger"].alias("trigger"), confidence.alias("confidence"), x["priority"].alias("priority"))

    bound = F.transform(F.filter(F.array(best), lambda x: x.isNotNull()), verdict)
    return F.get(F.filter(bound, lambda x: x["confidence"] > 0), F.lit(0))


def with_class(df: DataFrame, sentence: str, name: str = "_c") -> DataFrame:
    """Rows whose sentence has a class, with it: derived once for both."""
    return df.select("*", F.explode(F.array_compact(F.array(classified(F.col(sentence))))).alias(name))


def section_of(header: Column) -> Column:
    """Label of a section's header; null for an unknown one."""
    out = F.lit(None).cast("string")
    for label, pattern, _, _ in reversed(SECTIONS):
        out = F.when(header.rlike(f"(?i)\\b(?:{pattern})\\b"), label).otherwise(out)
    return out


def section_boost(label: Column) -> Column:
    out = F.lit(0.0)
    for name, _, boost, _ in SECTIONS:
        out = F.when(label == name, boost).otherwise(out)
    return out


def section_lines(docs: DataFrame, md: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no, line, section): each line under the last header before it."""
    rows = docs.select(key, F.posexplode(text.lines(F.col(md))).alias("line_no", "line"))
    header = F.when(text.header_level(F.col("line")) != -2, text.header_title(F.col("line"))).when(F.btrim("line").rlike(r"^[A-Z][^.!?]{2,60}:$"), F.regexp_replace(F.btrim("line"), ":$", ""))
    rows = rows.withColumn("_header", header)
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last("_header", ignorenulls=True).over(order)).filter(F.col("_header").isNull() & (F.btrim("line") != "")).drop("_header")


def by_section(docs: DataFrame, md: str = "text", key: str = "doc_id", least: float = 0.5, most: int = 20, targets_only: bool = True, like: float | None = None) -> DataFrame:
    """Requirements (key, requirement, trigger, base_confidence, section_boost, final_confidence, section) of each document, the best first.

    With ``like``, of requirements that are so like each other (by similarity.likeness) the longest alone is kept, before the best are taken.
    """
    rows = section_lines(docs, md, key).withColumn("label", section_of(F.col("section")))
    if targets_only:
        rows = rows.filter(F.col("label").isin(*[n for n, _, _, t in SECTIONS if t]))
    said = with_class(rows.select(key, "label", "line_no", F.posexplode(text.sentences(F.regexp_replace("line", text.BULLET, ""))).alias("n", "requirement")), "requirement")
    said = said.select(key, "line_no", "n", "requirement", F.col("_c.trigger").alias("trigger"), F.col("_c.confidence").alias("base_confidence"), section_boost(F.col("label")).alias("section_boost"), F.coalesce("label", F.lit("NONE")).alias("section"))
    said = said.withColumn("final_confidence", F.round(scalars.clamp(F.col("base_confidence") + F.col("section_boost")), 3)).filter(F.col("final_confidence") >= least)
    once = said.withColumn("_same", F.row_number().over(Window.partitionBy(key, F.lower(F.btrim("requirement"))).orderBy(F.desc("final_confidence"), "line_no", "n"))).filter("_same = 1")
    if like is not None:
        lists = once.groupBy(key).agg(F.sort_array(F.collect_list("requirement")).alias("_all"))  # a document's own
        kept = lists.select(key, F.explode(similarity.fuzzy_distinct(F.col("_all"), like)).alias("requirement"))
        once = once.join(kept, [key, "requirement"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("final_confidence"), "line_no", "n"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).drop("_same", "line_no", "n")


def extracted(docs: DataFrame, md: str = "text", key: str = "doc_id", least: float = 0.5, most: int = 25) -> DataFrame:
    """(key, company, sentences, requirements_count, requirements): the phrases of each text with a confidence of ``least`` or more,
    the best of equal ones, the most confident first, ``most`` of them at most; the company by the text's headers."""
    spans = F.filter(requirement_spans(F.col(md)), lambda x: x["confidence"] >= least)
    out = docs.select(key, _employer(F.col(md)).alias("company"), F.size(text.sentences(F.col(md))).alias("sentences"), spans.alias("_s"))
    ordered = F.transform(F.array_sort(F.transform("_s", lambda x: F.struct((-x["confidence"]).alias("less"), x["start"].alias("start"), x.alias("x")))), lambda x: x["x"])
    best = F.transform(F.slice(ordered, 1, most), lambda x: F.struct(*[x[n].alias(n) for n in ("text", "trigger_word", "confidence", "span_type")]))
    return out.select(key, "company", "sentences", F.size(best).alias("requirements_count"), best.alias("requirements"))


def _employer(md: Column) -> Column:
    """Text of the first header of level 1, else 2, else what stands after company or employer."""
    found = [F.btrim(F.regexp_extract(md, p, 1)) for p in (r"(?m)^#\s+([^\n]+)", r"(?m)^##\s+([^\n]+)", r"(?i)(?:company|employer):\s*([^\n]+)")]
    return F.coalesce(*[F.when(x != "", x) for x in found])


_PATTERNS = [(t, re.compile(p, re.I), c) for t, p, c in PHRASES]
#: A word of which each phrase must have one.
_BEGIN = [("required",), ("must",), ("essential",), ("ability",), ("experience", "background"), ("proficiency",), ("knowledge",), ("understanding",), ("should",), ("prefer",), ("bachelor", "master", "phd"), ("year",), ("nice",), ("ideal",), ("bonus",)]
_STARTS = sorted({w for ws in _BEGIN for w in ws})
_SEARCHED = [(*p, ws[0], ws[1:]) for p, ws in zip(_PATTERNS, _BEGIN, strict=True)]
_TOKEN = re.compile(r"\w+(?:[-'.+#]\w+)*[+#]*|[^\w\s]")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
_SPAN = "text string, trigger_word string, confidence double, start int, end int, expanded_start int, expanded_end int, span_text string, span_type string, conjunct_count int"
_FIELDS = [x.split()[0] for x in _SPAN.split(", ")]
_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
_KIND = pa.struct([(x.split()[0], _ARROW[x.split()[1]]) for x in _SPAN.split(", ")])


_IF, _NICE, _NOT = re.compile(r"\bif\b", re.I), re.compile(r"nice\s+to\s+have", re.I), re.compile(NEGATED)
#: Parts of which every negation holds one.
_NOT_PARTS = ("no", "never", "without", "n't")


def phrase_spans(body: str) -> list[dict]:
    """Requirement phrases of a text with their token-aligned spans; the best of equal texts."""
    return [dict(zip(_FIELDS, x, strict=True)) for x in _phrases(body)]


def _phrases(body: str) -> list[tuple]:
    """As ``phrase_spans``, in the order of its fields."""
    low = body.lower()
    here = [x for x in _SEARCHED if x[3] in low or (x[4] and any(word in low for word in x[4]))]
    if not here:
        return []
    # what a pattern can't find without its words isn't searched; beyond ASCII, letters fold in other ways
    plain = body.isascii()
    may_if, may_nice, may_not = not plain or "if" in low, not plain or "nice" in low, not plain or any(x in low for x in _NOT_PARTS)
    bounds: list[tuple[int, int]] = []
    best: dict[str, tuple] = {}
    for trigger, pattern, base, _, _ in here:
        for m in pattern.finditer(body):
            whole = m.group(1)
            found = whole.strip()
            start = m.start(1)
            end = start + len(whole.rstrip())
            score = base
            if may_if or may_not:
                bounds = bounds or [x.span() for x in _SENTENCE.finditer(body) if x.group()]
                at = bisect.bisect_right(bounds, (start, len(body) + 1)) - 1
                a, b = bounds[at] if at >= 0 and start < bounds[at][1] else (0, len(body))
                if may_not and _NOT.search(body[max(a, start - NEAR) : min(b, end + NEAR)]):
                    continue
                score -= 0.15 * bool(may_if and _IF.search(body[a:b]))
            score -= 0.25 * bool(may_nice and _NICE.search(found))
            score = round(min(1.0, max(0.0, score)), 3)
            if score <= 0 or not found:
                continue
            key = found.lower()
            rank = (score, 0 if plain and found == key else sum(map(str.isupper, found)), -start)
            if rank > best.get(key, ((-1.0, 0, 0),))[0]:
                best[key] = (rank, found, trigger, start, end)
    out = []
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(body)] if best else []
    begins = [t[0] for t in tokens]
    for (score, _, _), found, trigger, start, end in sorted(best.values(), key=lambda x: (x[3], x[2])):
        first, last = expanded(tokens, start, end)
        words = [t[2].lower() for t in tokens[bisect.bisect_left(begins, first) : bisect.bisect_left(begins, last)] if t[1] <= last]
        joins = words.count("and") + words.count("or")
        out.append((found, trigger, score, start, end, first, last, body[first:last], "compound" if joins else "atomic", 1 + joins))
    return out


def expanded(tokens: list[tuple[int, int, str]], start: int, end: int) -> tuple[int, int]:
    """A span moved past a leading article, on to the end of its clause, and back over closing marks."""
    # tokens that a span touches: they are in order and don't overlap
    first = bisect.bisect_right(tokens, start, key=lambda t: t[1])
    last = bisect.bisect_left(tokens, end, key=lambda t: t[0]) - 1
    if first > last:
        return start, end
    while first < last and tokens[first][2].lower() in ARTICLES:
        first += 1
    while last + 1 < len(tokens):
        word = tokens[last + 1][2].lower()
        after = tokens[last + 2][2].lower() if last + 2 < len(tokens) else ""
        if word in ".;!?)" or word in SUBORDINATORS or (word == "," and after not in ("and", "or")):
            break
        last += 1
    while last > first and not tokens[last][2][0].isalnum():
        last -= 1
    return tokens[first][0], tokens[last][1]


def span_lists(texts: pa.Array) -> pa.Array:
    """Lists of spans of a batch's texts, each different text searched once."""
    coded = texts.dictionary_encode("encode")
    found = [_phrases(x or "") for x in coded.dictionary.to_pylist()]
    offsets = pa.array(accumulate(map(len, found), initial=0), pa.int32())
    columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * len(_FIELDS)
    spans = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _KIND, strict=True)], fields=list(_KIND))
    return pa.ListArray.from_arrays(offsets, spans).take(coded.indices)


def requirement_spans(body: Column) -> Column:
    """Column of spans: phrases with offsets in code points, expanded over tokens; null gives none."""

    @arrow_udf(f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _SPAN.split(', '))}>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield span_lists(arr)

    # texts without a word that any phrase begins with go over as nulls
    return spans(F.when(reduce(lambda a, b: a | b, [F.lower(body).contains(w) for w in _STARTS]), body))
