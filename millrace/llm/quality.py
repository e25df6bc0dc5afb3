"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character-class histogram and its common-word histogram are compared with those of its language over the
whole corpus (integer sums, so the references do not depend on the order of rows) by Jensen-Shannon distance. Both
limits widen as 1 / sqrt(words), as the distance of a small sample from its own source does; documents under the
minimum lengths are judged by the base rules alone.

Two passes over the text: one sums the references (one row for each language, and for languages without a word list one for
each script without case as well), the other judges each row beside them. Nothing but those few rows is shuffled or broadcast.

Defined results: a null or empty text has no words and fails the base rule; a language without a word list is compared by
character classes with the documents of the same language and script, a null one with those of null; repeated rows are
judged alike; extra columns pass through.
Windows of three words are compared by a chained 64-bit hash of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

#: Frequent function words of each language (fixed values).
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
}
SPACE = r"\x20\x09-\x0D"
#: Characters that trim() takes off: those of SPACE.
TRIMMED = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: Counted classes beside lower-case letters, white space and the rest.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"[.,;:'\"()?-]"}
#: Most characters of most texts; the other classes are counted in what is left without them.
PLAIN = rf"[\p{{Ll}}{SPACE}]+"

MIN_WORDS = 50
MIN_CHARS = 200
#: Scripts without case, and all their letters and marks.
SCRIPTS = ["Arabic", "Hebrew", "Devanagari", "Bengali", "Tamil", "Thai", "Han", "Hiragana", "Katakana", "Hangul"]
CASELESS = r"[\p{Lo}\p{M}]"
#: Share of lower-case letters, or of letters without case, in the words of a document that counts for a reference.
MIN_LETTERS = 0.85
#: Rows of references that are broadcast; beyond, they meet the documents in a shuffle.
REFERENCES = 10_000
#: Limits of the two distances: the floor, and what 1 / sqrt(words) is multiplied by.
CLASS_FLOOR, CLASS_SPREAD = 0.16, 1.45
WORD_FLOOR, WORD_SPREAD = 0.22, 2.7


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(TRIMMED))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit("other"))


def _script(marked: Column, caseless: Column) -> Column:
    """The script of most of the letters without case."""
    found = F.lit("caseless")
    for name in reversed(SCRIPTS):
        found = F.when(2 * F.regexp_count(marked, F.lit(rf"[\p{{Is{name}}}&&[\p{{Lo}}\p{{M}}]]")) > caseless, name).otherwise(found)
    return found


def _among(words: list[str]):
    written = [x for w in words for x in dict.fromkeys((w, w.capitalize(), w.upper()))]
    return lambda w: w.isin(*written)


def _histograms(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``df`` with _words, _language, _group (whose reference it has), _letters, _classes and _common (counts as array<bigint>)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_language": _language(F.col(lang)), "_words": _words(whole), "_marked": F.regexp_replace(whole, PLAIN, "")})
    listed = F.lit(None)
    known = F.lit(None)
    for name, words in COMMON.items():
        here = F.col("_language") == name
        listed = F.when(here, F.array(*map(F.lit, words))).otherwise(listed)
        known = F.when(here, F.transform(F.filter("_words", _among(words)), lambda w: F.lower(w))).otherwise(known)
    df = df.withColumns({"_list": listed, "_known": known})
    counts = {k: F.regexp_count(F.col("_marked"), F.lit(p)).cast("long") for k, p in CLASSES.items()}
    df = df.withColumns({"_chars": F.length(whole).cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "_marks": F.length("_marked").cast("long"), **{f"_{k}": c for k, c in counts.items()}})
    # cased texts of a listed language need no second count
    caseless = F.when(F.col("_language") == "other", F.regexp_count("_marked", F.lit(CASELESS)).cast("long")).otherwise(F.lit(0).cast("long"))
    df = df.withColumns({"_lower": F.col("word_chars") - F.col("_marks"), "_caseless": caseless})
    without = F.col("_caseless") > F.col("_lower") + F.col("_upper")
    own = F.struct(F.when(F.col("_language") == "other", F.col(lang)).alias("lang"), F.when(without, _script(F.col("_marked"), F.col("_caseless"))).alias("script"))
    group = F.when(F.col("_language") == "other", F.to_json(own)).otherwise(F.col("_language"))
    df = df.withColumns({"_group": group, "_letters": F.when(without, F.col("_caseless")).otherwise(F.col("_lower"))})
    rest = F.col("_marks")
    for k in counts:
        rest = rest - F.col(f"_{k}")
    common = F.transform("_list", lambda k: F.size(F.filter("_known", lambda w: w == k)).cast("long"))
    return df.withColumns(
        {
            "_classes": F.array(F.col("_lower"), F.col("_chars") - F.col("word_chars"), *[F.col(f"_{k}") for k in counts], rest),
            "_common": F.when(F.col("_list").isNotNull(), F.concat(common, F.array((F.size("_words") - F.size("_known")).cast("long")))).otherwise(F.array(F.size("_words").cast("long"))),
        }
    )


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(_group, _ref_classes, _ref_common): summed counts of all documents of MIN_WORDS words or more, MIN_LETTERS of whose
    characters in words are lower-case letters, or letters of a script without case; a group without such documents has no reference and isn't judged."""
    marked = _histograms(df.select(F.col(text).alias("text"), F.col(lang).alias("lang")), "text", "lang")
    # not a filter, which would be pushed down and derive the words a second time
    counted = (F.size("_words") >= MIN_WORDS) & (F.col("_letters") >= F.lit(MIN_LETTERS) * F.col("word_chars"))
    marked = marked.select("_group", F.when(counted, F.col("_classes")).alias("_classes"), F.when(counted, F.col("_common")).alias("_common"))
    sums = {f"c{i}": F.sum(F.get("_classes", F.lit(i))) for i in range(len(CLASSES) + 3)}
    longest = 1 + max(map(len, COMMON.values()))
    sums |= {f"w{i}": F.sum(F.get("_common", F.lit(i))) for i in range(longest)}
    found = marked.groupBy("_group").agg(*[c.alias(k) for k, c in sums.items()])
    return found.select("_group", F.array(*[f"c{i}" for i in range(len(CLASSES) + 3)]).alias("_ref_classes"), F.array_compact(F.array(*[f"w{i}" for i in range(longest)])).alias("_ref_common"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count vectors of the same length; null where one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    shares = lambda a: F.transform(a, lambda x: F.try_divide(x.cast("double"), total(a)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(shares(counts), shares(reference), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2))


def _repeated(df: DataFrame) -> DataFrame:
    """``df`` with n_repeat_words: words of _words that stand in a window of three that is found twice or more."""
    n = F.size("_words")
    windows = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_windows", F.when(n >= 3, F.slice(windows, F.lit(1), n - 2)).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, k: (F.get("_sorted", k - 1)["h"] == e["h"]) | (F.get("_sorted", k + 1)["h"] == e["h"])
    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"])))
    gaps = F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda x, y: x + y.cast("long")), F.lit(0).cast("long")))


def judged(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept."""
    names = df.columns
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
    whole = F.coalesce(F.col(text), F.lit(""))
    out = _repeated(_histograms(df.select(*[c for c in names if c not in made]), text, lang))
    out = out.withColumn("_lines", F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(TRIMMED)) != ""))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_symbols": F.regexp_count(F.col("_marked"), F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    known = checkpointed(references(df, text, lang))
    # languages without a word list have a row for each value and script: they may be garbage without number
    out = out.join(F.broadcast(known) if known.count() <= REFERENCES else known, "_group", "left")
    out = out.withColumns({"class_distance": distance(F.col("_classes"), F.col("_ref_classes")), "word_distance": distance(F.col("_common"), F.col("_ref_common"))})
    n = F.greatest(F.col("n_words"), F.lit(1))
    over = lambda d, floor, spread: F.coalesce(F.col(d) > F.greatest(F.lit(floor), F.lit(spread) / F.sqrt(n)), F.lit(False))
    odd = (F.col("n_words") >= MIN_WORDS) & (F.col("_chars") >= MIN_CHARS) & (over("class_distance", CLASS_FLOOR, CLASS_SPREAD) | over("word_distance", WORD_FLOOR, WORD_SPREAD))
    # always true, but not deterministic for the optimizer: a filter on the verdicts isn't pushed down, which would put the whole
    # derivation of the words inside the functions that run for each word
    fence = F.spark_partition_id() >= 0
    out = out.withColumn("base_failed", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))) & fence)
    out = out.withColumn("kept", ~F.col("base_failed") & ~odd & fence)
    return out.select(*[F.col(f"`{c}`") for c in names if c not in made], *made)
