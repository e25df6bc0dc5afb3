"""Dates, numbers, display formats and JSON fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def utc_date(text: Column) -> Column:
    """Midnight UTC of a YYYY-MM-DD text; null for any other."""
    return F.try_to_timestamp(text, F.lit("yyyy-M-d"))


def iso_moment(text: Column) -> Column:
    """Moment of an ISO text, with Z, an offset or neither (UTC); null where it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def older_than(moment: Column, days: int, now: Column | None = None) -> Column:
    return moment <= (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days))


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Tokens estimated from words: 1.3 for each, at least 1; 0 for an empty text."""
    n = F.size(words(text))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), (n * F.lit(1.3)).cast("int"))).cast("long")


def bpe_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens of a byte-pair vocabulary, a tokenizers JSON file that is read where this is called; null counts as empty.

    Without the library, or for no vocabulary at hand, ``word_tokens`` is the estimate.
    """
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()

    @arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Tokenizer.from_str(spec)
        known.no_truncation()
        known.no_padding()
        for arr in batches:
            yield pa.array([len(x.ids) for x in known.encode_batch([t or "" for t in arr.to_pylist()], add_special_tokens=False)], pa.int64())

    return of(text)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def truncated(text: Column, longest: int = 50) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)


def usd(x: Column, digits: int = 6) -> Column:
    return F.format_string(f"$%.{digits}f", x.cast("double"))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def duration(seconds: Column) -> Column:
    """Xm Ys, or Ys below a minute."""
    whole = F.floor(seconds).cast("long")
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.concat((F.floor(whole / 60)).cast("long").cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))


def rate(count: Column, seconds: Column) -> Column:
    return F.format_string("%.1f/s", F.coalesce(F.try_divide(count.cast("double"), seconds.cast("double")), F.lit(0.0)))


def bar(score: Column, width: int = 20) -> Column:
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.floor(score / 100 * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def minute(text: Column) -> Column:
    """YYYY-MM-DD HH:MM of a moment's text, its first 16 characters if it isn't one, or a remark for null."""
    return F.when(text.isNull(), "not processed").otherwise(F.coalesce(F.date_format(iso_moment(text), "yyyy-MM-dd HH:mm"), F.substring(text, 1, 16)))


def json_list(text: Column) -> Column:
    """Texts of a JSON list; null for anything else."""
    return F.from_json(text, "array<string>")


def scoring_reply(text: Column) -> Column:
    """Struct of a scoring reply, code fences around it taken off; null if one of its four scores isn't there."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    got = F.from_json(bare, "overall_score double, tech_score double, seniority_score double, location_score double, recommendations array<string>, summary string")
    whole = got["overall_score"].isNotNull() & got["tech_score"].isNotNull() & got["seniority_score"].isNotNull() & got["location_score"].isNotNull()
    return F.when(whole, got)


def scoring_defaults(reply: Column) -> Column:
    """A reply with 50 for absent scores and empty fields for the others."""
    fifty = lambda n: F.coalesce(reply[n], F.lit(50.0)).alias(n)
    return F.struct(*map(fifty, ("overall_score", "tech_score", "seniority_score", "location_score")), F.coalesce(reply["recommendations"], F.array().cast("array<string>")).alias("recommendations"), F.coalesce(reply["summary"], F.lit("")).alias("summary"))
