"""Scores of postings against a profile, prompts, and the boundary to an outside scorer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars

#: Weights of a posting's overall score (fixed values).
TECH, SENIORITY, LOCATION = 0.4, 0.3, 0.3


def overlap(have: Column, want: Column) -> Column:
    """Percent of the wanted entities that are there, without regard to case; 100 if nothing is wanted."""
    low = lambda a: F.array_distinct(F.transform(a, lambda x: F.lower(x)))
    n = F.size(low(want))
    return F.when(n == 0, 100.0).otherwise(F.size(F.array_intersect(low(have), low(want))) * 100.0 / n)


def entity_scores(jobs: DataFrame, profile: DataFrame) -> DataFrame:
    """Postings (skills, technologies, requirements) with four scores against the one row of a profile of the same columns."""
    own = profile.limit(1).select(*[F.col(c).alias(f"_{c}") for c in ("skills", "technologies", "requirements")])
    out = jobs.crossJoin(F.broadcast(own))  # one row
    parts = {"skill_match": "skills", "tech_match": "technologies", "requirements_match": "requirements"}
    out = out.withColumns({k: overlap(F.col(f"_{c}"), F.col(c)) for k, c in parts.items()})
    return out.withColumn("overall_entity_score", (F.col("skill_match") + F.col("tech_match") + F.col("requirements_match")) / 3).drop("_skills", "_technologies", "_requirements")


def savings(actual: Column, baseline: Column) -> Column:
    """Percent of a baseline's tokens that weren't needed."""
    return F.coalesce((1 - F.try_divide(actual, baseline)) * 100, F.lit(0.0))


def weighted(tech: Column, seniority: Column, location: Column) -> Column:
    return tech * TECH + seniority * SENIORITY + location * LOCATION


def prompt(title: Column, company: Column, body: Column, profile: Column) -> Column:
    """Text that asks for a score of a posting for a profile."""
    return F.concat_ws("\n\n", F.concat(F.lit("# Posting\n"), F.concat_ws(" at ", title, company)), body, F.concat(F.lit("# Profile\n"), profile), F.lit("Answer in JSON with overall_score, tech_score, seniority_score, location_score, recommendations and summary."))


def assessed(jobs: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Postings with what a scorer returns; a scorer is any function that adds the score columns, by default none calls out."""
    return scorer(jobs)


#: Scores of a posting whose scorer gave none (a fixed value).
MIDDLE = 50.0


def replied(jobs: DataFrame, ask: Callable[[str], str], prompt_column: str = "prompt", attempts: int = 3, pause: float = 0.5, longest: float = 30.0) -> DataFrame:
    """``jobs`` with reply (a scorer's answer), attempts and error: one call for each row, from the workers.

    A call that fails is made again after a pause that doubles up to ``longest``; a row for which every call fails keeps its
    error and a null reply, and no other row is touched by it. ``ask`` must give the same or an equally good answer when it is
    asked again, as lost tasks are run anew.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_asked(ask, x, attempts, pause, longest) for x in batch.column(prompt_column).to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "reply", "attempts", "error"])

    kept = jobs.drop("reply", "attempts", "error")
    return kept.mapInArrow(call, T.StructType([*kept.schema.fields, *T.StructType.fromDDL("reply string, attempts int, error string").fields]))


def _asked(ask: Callable[[str], str], text: str | None, attempts: int, pause: float, longest: float) -> tuple[str | None, int, str | None]:
    error = None
    for k in range(attempts):
        if k and pause:
            time.sleep(min(longest, pause * 2 ** (k - 1)))
        try:
            return ask(text or ""), k + 1, None
        except Exception as failure:  # noqa: BLE001 - whatever a caller's function raises belongs to its row
            error = f"{type(failure).__name__}: {failure}"
    return None, attempts, error


def scored_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """``df`` with the scores, recommendations and summary of its replies; MIDDLE scores and is_default where a reply can't be read."""
    got = scalars.scoring_reply(F.col(reply))
    names = ("overall_score", "tech_score", "seniority_score", "location_score")
    out = df.withColumn("_got", got).withColumn("is_default", F.col("_got").isNull())
    return out.withColumns({**{n: F.coalesce(f"_got.{n}", F.lit(MIDDLE)) for n in names}, "recommendations": F.coalesce("_got.recommendations", F.array().cast("array<string>")), "summary": F.coalesce("_got.summary", F.lit(""))}).drop("_got")


def offline(df: DataFrame) -> DataFrame:
    """A scorer without calls: entity scores stand for the parts, a middle score for the location."""
    return df.withColumns({"tech_score": F.col("tech_match"), "seniority_score": F.col("skill_match"), "location_score": F.lit(50.0)}).withColumn("overall_score", weighted(F.col("tech_score"), F.col("seniority_score"), F.col("location_score")))
