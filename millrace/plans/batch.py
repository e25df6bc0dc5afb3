"""The batch run: crawled postings to preprocessed rows, reviews, assessments and a report, as far as asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import identity, lexicons, scalars, text
from millrace.operators import chunking, mutations, report, requirements, scoring

PHASES = ("preprocess", "review", "assess", "export")


def preprocessed(jobs: DataFrame, target_tokens: int = 400, with_spans: bool = True) -> DataFrame:
    """Postings (id, title, company, location, url, description) with text, sentences, chunks, entities, tokens and cost."""
    out = jobs.withColumn("job_id", F.coalesce(F.col("id").cast("string"), identity.job_id(F.col("company"), F.col("title"), F.col("location"), F.col("url"))))
    # what is exploded is derived once: filters and functions after it don't repeat its expressions
    out = text.once(text.once(out, "clean_text", text.posting_text(F.col("title"), F.col("location"), F.col("description"))), "sentences", text.sentences(F.col("clean_text")))
    out = out.withColumns({"skills": lexicons.found_phrases(F.col("clean_text"), lexicons.terms(lexicons.SOFT_SKILLS)), "technologies": lexicons.found_words(F.col("clean_text"), lexicons.terms(lexicons.TECHNOLOGY))})
    out = out.withColumn("chunks", chunking.chunked(F.col("sentences"), max(1, target_tokens // 4)))
    out = out.withColumn("token_count", chunking.total_tokens(F.col("chunks")))
    out = out.withColumn("requirements", F.filter("sentences", lambda s: requirements.classified(s).isNotNull()))
    if with_spans:
        out = out.withColumn("trigger_requirements", requirements.requirement_spans(F.col("clean_text")))
    return out


def valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preprocessed rows that can be assessed, and those that can't: no text, raw HTML, or no tokens."""
    bad = text.is_raw_html(F.col("clean_text")) | F.coalesce(F.col("token_count") <= 0, F.lit(True))
    return df.filter(~bad), df.filter(bad)


def run(jobs: DataFrame, decisions: DataFrame | None = None, profile: DataFrame | None = None, up_to: str = "export", scorer: Callable[[DataFrame], DataFrame] = scoring.offline) -> DataFrame:
    """Result of a phase; without decisions all postings are confirmed, only confirmed ones are assessed."""
    if up_to not in PHASES:
        raise ValueError(f"unknown phase: {up_to}")
    ready = preprocessed(jobs)
    if up_to == "preprocess":
        return ready
    reviews = ready.withColumns({"status": F.lit("pending_review"), "reason": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("string")})
    reviews = mutations.confirmed(reviews) if decisions is None else mutations.decided(reviews, decisions, "now")
    if up_to == "review":
        return reviews
    if profile is None:
        raise ValueError("a profile is needed to assess")
    done = scoring.assessed(scoring.entity_scores(valid(reviews.filter("status = 'confirmed'"))[0], profile), scorer)
    if up_to == "assess":
        return done
    rows = done.select("job_id", "title", "company", "location", "overall_score", F.to_json("requirements").alias("recommendations"), F.element_at("sentences", 1).alias("summary"), F.col("token_count").alias("input_tokens"), F.lit(300).alias("output_tokens"))
    return report.markdown(rows)


def costs(df: DataFrame, input_price: float = 3.0, output_price: float = 15.0, output_tokens: int = 300) -> DataFrame:
    from millrace.operators import cost

    return df.withColumn("estimated_cost", cost.call_cost(F.col("token_count"), F.lit(output_tokens), input_price, output_price))


__all__ = ["PHASES", "costs", "preprocessed", "run", "scalars", "valid"]
