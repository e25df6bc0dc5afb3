"""Relational queries over postings, reviews and assessments.

Rows that tie in a query's order are ordered by their id, so that every limit is deterministic. Scores of exactly 100 fall
in no bin of the half-open distributions and scores between 74 and 75 in no band, as the rules say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filtered(df: DataFrame, status: str | None = None, company: str | None = None) -> DataFrame:
    """Rows of a status and a company, either optional."""
    return df.filter(all_of([F.col(c) == v for c, v in (("status", status), ("company", company)) if v is not None]))


def newest(df: DataFrame, limit: int | None = 100, time: str = "crawled_at", key: str = "id") -> DataFrame:
    out = df.orderBy(F.desc_nulls_last(time), key)
    return out.limit(limit) if limit is not None else out


def by_key(df: DataFrame, value, key: str = "job_id") -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def version(text: str) -> str:
    """A legal preprocessing version with its v; ValueError for any other."""
    found = text if text.startswith("v") else f"v{text}"
    if found not in ("v1.0", "v2.0"):
        raise ValueError(f"unknown preprocessing version: {text}")
    return found


def of_version(reviews: DataFrame, text: str) -> DataFrame:
    return reviews.filter(F.col("preprocessing_version") == version(text))


def scored_between(df: DataFrame, low: float = 70, high: float = 100, company: str | None = None, limit: int | None = None) -> DataFrame:
    """Assessments in a closed range of scores, best first."""
    out = filtered(df.filter(F.col("overall_score").between(low, high)), company=company).orderBy(F.desc("overall_score"), "job_id")
    return out.limit(limit) if limit is not None else out


def since(df: DataFrame, moment: str, limit: int = 100, key: str = "job_id") -> DataFrame:
    return newest(df.filter(F.col("crawled_at") >= moment), limit, key=key)


def below(jobs: DataFrame, assessments: DataFrame, threshold: float = 50) -> DataFrame:
    """Postings whose assessment is under a threshold."""
    scored = assessments.filter(F.col("overall_score") < threshold).select("job_id", "overall_score", "summary")
    return scored.join(jobs, scored["job_id"] == jobs["id"]).drop("id").orderBy("overall_score", "job_id")


def top_matches(jobs: DataFrame, assessments: DataFrame, limit: int = 10) -> DataFrame:
    """Best assessed postings: the top is taken before the join, which every assessment survives."""
    best = assessments.select("job_id", "overall_score", "tech_score").join(jobs.select("id", "title", "company", "location"), F.col("job_id") == F.col("id")).drop("id")
    return best.orderBy(F.desc("overall_score"), "job_id").limit(limit)


def reprocess_candidates(reviews: DataFrame, assessments: DataFrame | None = None, version_is: str = "1.0", as_of: str | None = None, min_age_days: int | None = None, max_score: float | None = None, min_tokens: int | None = None, companies: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Reviews to process again, oldest first; max_score compares the assessment's overall score."""
    conditions = [F.col("preprocessing_version") == version(version_is)]
    if min_age_days is not None:
        now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        conditions.append(F.col("crawled_at").cast("timestamp") <= now - F.make_dt_interval(F.lit(min_age_days)))
    if min_tokens is not None:
        conditions.append(F.col("tokens") >= min_tokens)
    if companies:
        conditions.append(F.col("company").isin(companies))
    out = reviews.filter(all_of(conditions))
    if max_score is not None and assessments is not None:
        out = out.join(assessments.filter(F.col("overall_score") <= max_score).select("job_id"), "job_id", "left_semi")
    out = out.orderBy("crawled_at", "job_id")
    return out.limit(limit) if limit is not None else out


def enabled(companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies that are enabled (by default they are), and those that aren't."""
    on = F.coalesce("enabled", F.lit(True))
    return companies.filter(on), companies.filter(~on)


def new_only(reviews: DataFrame, assessments: DataFrame, mode: str = "new-only") -> DataFrame:
    if mode not in ("new-only", "all"):
        raise ValueError(f"unknown mode: {mode}")
    return reviews if mode == "all" else reviews.join(assessments.select("job_id"), "job_id", "left_anti")


def without_low_scores(reviews: DataFrame, assessments: DataFrame, threshold: float) -> DataFrame:
    """Reviews never assessed, or assessed at the threshold or more."""
    prior = assessments.select("job_id", F.col("overall_score").alias("prior_score"))
    return reviews.filter(F.col("job_id").isNotNull()).join(prior, "job_id", "left").filter(F.col("prior_score").isNull() | (F.col("prior_score") >= threshold))


def since_or_unknown(df: DataFrame, moment: str) -> DataFrame:
    return df.filter(F.col("crawled_at").isNull() | (F.col("crawled_at") >= moment))


def skip_reason(assessed: Column, status: Column, crawled: Column, mode: str = "all", skip_before: str | None = None, skip_rejected: bool = False, skip_assessed: bool = False) -> Column:
    """First reason of the chain to pass a posting over; null if there is none."""
    chain = F.lit(None).cast("string")
    if skip_before:
        chain = F.when(crawled < skip_before, f"crawled_before_{skip_before}").otherwise(chain)
    if skip_assessed:
        chain = F.when(assessed, "already_assessed").otherwise(chain)
    if skip_rejected:
        chain = F.when(status == "rejected", "previously_rejected").otherwise(chain)
    if mode == "new-only":
        chain = F.when(status.isin("confirmed", "rejected"), "already_reviewed").otherwise(chain)
    return chain


def with_skip_reason(reviews: DataFrame, assessments: DataFrame, **rules) -> DataFrame:
    marked = assessments.select("job_id").distinct().withColumn("is_assessed", F.lit(True))
    return reviews.join(marked, "job_id", "left").withColumn("skip_reason", skip_reason(F.coalesce("is_assessed", F.lit(False)), F.col("status"), F.col("crawled_at"), **rules)).drop("is_assessed")


def filter_stats(reviews: DataFrame, assessments: DataFrame, **rules) -> DataFrame:
    """total, would_process, would_skip, and one count for each reason, as rows."""
    reasons = with_skip_reason(reviews, assessments, **rules).groupBy(F.coalesce("skip_reason", F.lit("process")).alias("outcome")).agg(F.count("*").alias("n"))
    return reasons


def derived_status(reviews: DataFrame, assessments: DataFrame) -> DataFrame:
    """(job_id, status): assessed if it is in assessments, else the review's status, else pending_review."""
    one = reviews.select("job_id", F.col("status").alias("reviewed"))
    two = assessments.select("job_id").distinct().withColumn("assessed", F.lit(True))
    return one.join(two, "job_id", "full").select("job_id", F.coalesce(F.when(F.col("assessed"), F.lit("assessed")), "reviewed", F.lit("pending_review")).alias("status"))


def search_like(jobs: DataFrame, assessments: DataFrame, term: str, min_score: float | None = None) -> DataFrame:
    """Postings with a term in title, company or location, with their scores; a minimum applies to all of them."""
    pattern = f"%{term}%"
    out = jobs.filter(F.col("title").ilike(pattern) | F.col("company").ilike(pattern) | F.col("location").ilike(pattern))
    out = out.join(assessments.select(F.col("job_id").alias("id"), "overall_score"), "id", "left")
    if min_score is not None:
        out = out.filter(F.col("overall_score") >= min_score)
    return out.orderBy(F.desc_nulls_last("overall_score"), "id")


def needing_assessment(reviews: DataFrame, assessments: DataFrame, limit: int = 100) -> DataFrame:
    """Confirmed reviews without an assessment, newest first."""
    return newest(reviews.filter("status = 'confirmed'").join(assessments.select("job_id"), "job_id", "left_anti"), limit, key="job_id")


def with_assessed_flag(reviews: DataFrame, assessments: DataFrame) -> DataFrame:
    marked = assessments.select("job_id").distinct().withColumn("is_assessed", F.lit(1))
    return reviews.join(marked, "job_id", "left").fillna(0, ["is_assessed"])


def lifecycle(reviews: DataFrame, assessments: DataFrame) -> DataFrame:
    """(job_id, event, at): crawl, review and assessment of each posting, in long form."""
    both = reviews.select("job_id", "crawled_at", "reviewed_at").join(assessments.select("job_id", "assessed_date"), "job_id", "full")
    return both.select("job_id", F.expr("stack(3, 'crawled', crawled_at, 'reviewed', reviewed_at, 'assessed', assessed_date) AS (event, at)")).filter("at IS NOT NULL")


def assessment_stats(df: DataFrame) -> DataFrame:
    """One row of totals, zeros where there are no assessments."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.agg(
        F.count("*").alias("total"), F.round(zero(F.avg("overall_score")), 6).alias("avg_score"), zero(F.max("overall_score")).alias("max_score"), zero(F.min("overall_score")).alias("min_score"),
        F.round(zero(F.sum("actual_cost")), 6).alias("total_cost"), zero(F.sum("tokens_used")).alias("tokens_used"), zero(F.sum("input_tokens")).alias("input_tokens"), zero(F.sum("output_tokens")).alias("output_tokens"),
        F.round(zero(F.try_divide(F.sum("actual_cost"), F.count("*"))), 6).alias("avg_cost"),
    )


def binned(df: DataFrame, edges: list[tuple[str, float, float]]) -> DataFrame:
    """(band, n) of half-open bins, all in one pass."""
    one = df.agg(*[F.count_if((F.col("overall_score") >= a) & (F.col("overall_score") < b)).alias(name) for name, a, b in edges])
    pairs = ", ".join(f"'{name}', `{name}`" for name, _, _ in edges)
    return one.select(F.expr(f"stack({len(edges)}, {pairs}) AS (band, n)"))


DISTRIBUTION = [("poor", 0, 50), ("fair", 50, 70), ("good", 70, 85), ("excellent", 85, 100)]
RANGES = [("0-25", 0, 25), ("25-50", 25, 50), ("50-75", 50, 75), ("75-100", 75, 100)]


def company_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("company").agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 2).alias("avg_score"), F.max("overall_score").alias("max_score"), F.min("overall_score").alias("min_score"), F.round(F.sum("actual_cost"), 4).alias("total_cost")).orderBy(F.desc("n"), "company")


def company_stats(df: DataFrame, company: str) -> DataFrame:
    """Counts of the three bands, and totals, of one company."""
    s = F.col("overall_score")
    return filtered(df, company=company).agg(F.count_if(s >= 75).alias("high"), F.count_if(s.between(50, 74)).alias("medium"), F.count_if(s < 50).alias("low"), F.count("*").alias("total"), F.round(F.avg(s), 6).alias("avg_score"), F.round(F.sum("actual_cost"), 6).alias("total_cost"))


def companies(df: DataFrame) -> DataFrame:
    return df.select("company").filter("company IS NOT NULL").distinct().orderBy("company")


#: Words that say nothing of a posting (fixed values).
DULL = ("with", "from", "that", "this", "have", "will", "your")


def top_keywords(df: DataFrame, limit: int = 20, company: str | None = None) -> DataFrame:
    """Most frequent words of titles and summaries; ties in order of the word."""
    words = F.explode(F.split(F.lower(F.concat_ws(" ", "title", "summary")), r"\s+"))
    bare = filtered(df, company=company).select(words.alias("w")).select(F.regexp_replace("w", r"^[.,;:!?()\-]+|[.,;:!?()\-]+$", "").alias("word"))
    return bare.filter((F.length("word") > 3) & ~F.col("word").isin(*DULL)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def recommendations(df: DataFrame) -> DataFrame:
    """(recommendation, n) over JSON lists; anything else is passed over."""
    return df.select(F.explode(F.from_json("recommendations", "array<string>")).alias("recommendation")).groupBy("recommendation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "recommendation")


def pipeline_stats(reviews: DataFrame, assessments: DataFrame) -> DataFrame:
    """Counts of the known statuses, and of assessments, as (status, n); other statuses are dropped."""
    counts = reviews.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending_review", "confirmed", "rejected")])
    assessed = assessments.agg(F.count("*").alias("assessed"))
    return counts.crossJoin(assessed).select(F.expr("stack(4, 'pending_review', pending_review, 'confirmed', confirmed, 'rejected', rejected, 'assessed', assessed) AS (status, n)"))


def job_stats(jobs: DataFrame, assessments: DataFrame) -> DataFrame:
    """Tall table of metrics (metric, value)."""
    counts = jobs.agg(F.count("*").cast("double").alias("jobs"), F.count_if(F.col("status") == "confirmed").cast("double").alias("confirmed"), F.count_if(F.col("status") == "rejected").cast("double").alias("rejected"))
    scores = assessments.agg(F.count("*").cast("double").alias("assessed"), F.round(F.avg("overall_score"), 1).alias("avg_score"))
    return counts.crossJoin(scores).select(F.expr("stack(5, 'jobs', jobs, 'confirmed', confirmed, 'rejected', rejected, 'assessed', assessed, 'avg_score', avg_score) AS (metric, value)"))


def version_stats(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.coalesce(F.regexp_replace("preprocessing_version", "^v", ""), F.lit("unknown")).alias("version")).agg(F.count("*").alias("n"))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with is_duplicate: whether an earlier row has the same keys."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("is_duplicate", rank > 1)


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as a column says, from one pass: a union of a table with itself would make its rows anew."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).drop("_copy")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last writer of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def ranked(df: DataFrame, k: int, group: str, order: list[Column]) -> DataFrame:
    """Top k of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def assessment_counts(jobs: DataFrame, assessments: DataFrame) -> DataFrame:
    """Assessments of each posting, zeros included."""
    counts = assessments.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n"))
    return jobs.select("id").join(counts, "id", "left").fillna(0, ["n"])


def retention(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("status").agg(F.count("*").alias("n"), F.min("crawled_at").alias("first"), F.max("crawled_at").alias("last"))
