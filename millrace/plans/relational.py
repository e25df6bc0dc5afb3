"""Queries over postings, reviews, assessments and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import identity
from millrace.operators import cost, integrity, mutations, store
from millrace.plans.catalog import query
from millrace.sources.partitions import dealt

J = "id, title, company, location, crawled_at, status"
R = "job_id, title, company, status, reason, tokens, crawled_at, reviewed_at, preprocessing_version"
A = "job_id, title, company, overall_score"


@query("top_matches", f"SELECT job_id, overall_score, tech_score, title, company, location FROM assessments ORDER BY overall_score DESC, job_id LIMIT 10")
def _(v):
    return store.top_matches(v.jobs, v.assessments)


@query("jobs_by_status_company", f"SELECT {J} FROM jobs WHERE status = 'confirmed' AND company = 'BUILDING' ORDER BY crawled_at DESC, id LIMIT 100")
def _(v):
    return store.newest(store.filtered(v.jobs, "confirmed", "BUILDING"))


@query("reviews_by_status", f"SELECT {R} FROM reviews WHERE status = 'rejected'")
def _(v):
    return store.newest(store.filtered(v.reviews, "rejected"), None, key="job_id")


@query("job_lookup", f"SELECT {R} FROM reviews WHERE job_id = 42")
def _(v):
    return store.by_key(v.reviews, 42)


@query("assessment_lookup", "SELECT job_id, overall_score, recommendations FROM assessments WHERE job_id = 43")
def _(v):
    return store.by_key(v.assessments, 43).select("job_id", "overall_score", "recommendations")


@query("reviews_of_version", f"SELECT {R} FROM reviews WHERE preprocessing_version = 'v2.0'")
def _(v):
    return store.of_version(v.reviews, "2.0")


@query("assessments_by_score", f"SELECT {A} FROM assessments WHERE overall_score BETWEEN 70 AND 100 AND company = 'MACHINERY'")
def _(v):
    return store.scored_between(v.assessments, company="MACHINERY").select("job_id", "title", "company", "overall_score")


@query("assessments_in_range_top", f"SELECT {A} FROM assessments WHERE overall_score BETWEEN 30 AND 60 ORDER BY overall_score DESC, job_id LIMIT 100")
def _(v):
    return store.scored_between(v.assessments, 30, 60, limit=100).select("job_id", "title", "company", "overall_score")


@query("jobs_since", f"SELECT {R} FROM reviews WHERE crawled_at >= '1999-01-01' ORDER BY crawled_at DESC, job_id LIMIT 100")
def _(v):
    return store.since(v.reviews, "1999-01-01")


@query("below_threshold", "SELECT a.job_id, a.overall_score, a.summary, j.title, j.company, j.location, j.crawled_at, j.status FROM assessments a JOIN jobs j ON a.job_id = j.id WHERE a.overall_score < 40")
def _(v):
    return store.below(v.jobs, v.assessments, 40)


@query("confirmed_reviews", f"SELECT {R} FROM reviews WHERE status = 'confirmed'")
def _(v):
    return store.filtered(v.reviews, "confirmed").orderBy("reviewed_at", "job_id")


@query(
    "reprocess_candidates",
    f"SELECT {R} FROM reviews WHERE preprocessing_version = 'v1.0' AND crawled_at <= '2000-12-02 00:00:00' AND tokens >= 500 AND company IN ('BUILDING', 'FURNITURE') AND job_id IN (SELECT job_id FROM assessments WHERE overall_score <= 60) ORDER BY crawled_at, job_id LIMIT 50",
)
def _(v):
    return store.reprocess_candidates(v.reviews, v.assessments, "1.0", "2001-01-01 00:00:00", 30, 60, 500, ["BUILDING", "FURNITURE"], 50)


@query("regression_risk", "SELECT job_id, previous_assessment_score, new_assessment_score, score_delta, timestamp FROM quality WHERE score_delta <= -10 ORDER BY score_delta, job_id LIMIT 100")
def _(v):
    return cost.regression_risk(v.quality)


@query("new_only_reviews", f"SELECT {R} FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM assessments a WHERE a.job_id = r.job_id)")
def _(v):
    return store.new_only(v.reviews, v.assessments)


@query("without_low_scores", f"SELECT r.job_id, r.company, a.overall_score AS prior_score FROM reviews r LEFT JOIN assessments a ON r.job_id = a.job_id WHERE a.overall_score IS NULL OR a.overall_score >= 50")
def _(v):
    return store.without_low_scores(v.reviews, v.assessments, 50).select("job_id", "company", "prior_score")


@query("crawled_since_or_unknown", "SELECT job_id, reviewed_at AS crawled_at FROM reviews WHERE reviewed_at IS NULL OR reviewed_at >= '1999-06-01'")
def _(v):
    return store.since_or_unknown(v.reviews.select("job_id", F.col("reviewed_at").alias("crawled_at")), "1999-06-01")


_REASON = """SELECT job_id, CASE WHEN status = 'rejected' THEN 'previously_rejected' WHEN job_id IN (SELECT job_id FROM assessments WHERE overall_score >= 50) THEN 'already_assessed'
  WHEN crawled_at < '1998-01-01' THEN 'crawled_before_1998-01-01' END AS skip_reason FROM reviews"""


@query("skip_reasons", _REASON)
def _(v):
    return store.with_skip_reason(v.reviews, v.assessments.filter("overall_score >= 50"), skip_before="1998-01-01", skip_rejected=True, skip_assessed=True).select("job_id", "skip_reason")


@query("filter_stats", f"SELECT coalesce(skip_reason, 'process') AS outcome, count(*) AS n FROM ({_REASON}) GROUP BY 1")
def _(v):
    return store.filter_stats(v.reviews, v.assessments.filter("overall_score >= 50"), skip_before="1998-01-01", skip_rejected=True, skip_assessed=True)


@query("new_only_reasons", "SELECT job_id, CASE WHEN status IN ('confirmed', 'rejected') THEN 'already_reviewed' END AS skip_reason FROM reviews")
def _(v):
    return store.with_skip_reason(v.reviews, v.assessments, mode="new-only").select("job_id", "skip_reason")


@query("unconfirmed_count", "SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'confirmed') AS unconfirmed FROM reviews")
def _(v):
    return v.reviews.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "confirmed").alias("unconfirmed"))


@query("date_range", "SELECT job_id, crawled_at FROM reviews WHERE crawled_at >= '1997-03-01 00:00:00' AND crawled_at <= '1998-03-01 00:00:00'")
def _(v):
    at = F.try_to_timestamp("crawled_at")
    return v.reviews.filter(at.between(F.lit("1997-03-01").cast("timestamp"), F.lit("1998-03-01").cast("timestamp"))).select("job_id", "crawled_at")


@query("sorted_by_company", "SELECT job_id, company, overall_score FROM assessments WHERE overall_score >= 80 ORDER BY lower(company), job_id LIMIT 200")
def _(v):
    return v.assessments.filter("overall_score >= 80").orderBy(F.lower("company"), "job_id").limit(200).select("job_id", "company", "overall_score")


@query("search_and_status", f"SELECT {J} FROM jobs WHERE (contains(lower(title), 'ur') OR contains(lower(company), 'ur') OR contains(lower(location), 'ur')) AND status = 'pending_review'")
def _(v):
    has = lambda c: F.lower(c).contains("ur")
    return v.jobs.filter((has("title") | has("company") | has("location")) & (F.col("status") == "pending_review"))


@query("derived_status", "SELECT r.job_id, CASE WHEN a.job_id IS NOT NULL THEN 'assessed' ELSE coalesce(r.status, 'pending_review') END AS status FROM reviews r LEFT JOIN assessments a ON r.job_id = a.job_id")
def _(v):
    return store.derived_status(v.reviews, v.assessments)


@query("search_ilike", f"SELECT id, title, company, location, crawled_at, status, overall_score FROM jobs LEFT JOIN (SELECT job_id, overall_score FROM assessments) ON id = job_id WHERE (title ILIKE '%urgent%' OR company ILIKE '%urgent%' OR location ILIKE '%urgent%') AND overall_score >= 55")
def _(v):
    return store.search_like(v.jobs, v.assessments, "urgent", 55)


@query("jobs_needing_assessment", f"SELECT {R} FROM reviews WHERE status = 'confirmed' AND job_id NOT IN (SELECT job_id FROM assessments) ORDER BY crawled_at DESC, job_id LIMIT 100")
def _(v):
    return store.needing_assessment(v.reviews, v.assessments)


@query("assessed_flag", "SELECT job_id, status, CASE WHEN job_id IN (SELECT job_id FROM assessments) THEN 1 ELSE 0 END AS is_assessed FROM reviews")
def _(v):
    return store.with_assessed_flag(v.reviews, v.assessments).select("job_id", "status", "is_assessed")


@query(
    "timeline",
    """SELECT * FROM (SELECT job_id, 'crawled' AS event, crawled_at AS at FROM reviews UNION ALL SELECT job_id, 'reviewed', reviewed_at FROM reviews
  UNION ALL SELECT job_id, 'assessed', assessed_date FROM assessments) WHERE "at" IS NOT NULL""".replace("crawled_at AS at", 'crawled_at AS "at"'),
)
def _(v):
    return store.lifecycle(v.reviews, v.assessments)


@query("duplicate_jobs", "SELECT title, company, location, count(*) AS n FROM jobs GROUP BY ALL HAVING count(*) > 1")
def _(v):
    return store.duplicate_groups(v.jobs, ["title", "company", "location"])


@query("first_of_duplicates", "SELECT id, row_number() OVER (PARTITION BY title, company, location ORDER BY id) > 1 AS is_duplicate FROM jobs")
def _(v):
    return store.first_of(v.jobs, ["title", "company", "location"], ["id"]).select("id", "is_duplicate")


@query("assessment_counts", "SELECT id, count(a.job_id) AS n FROM jobs LEFT JOIN assessments a ON id = a.job_id GROUP BY id")
def _(v):
    return store.assessment_counts(v.jobs, v.assessments)


@query("assessment_stats", "SELECT count(*) AS total, round(avg(overall_score), 6) AS avg_score, max(overall_score) AS max_score, min(overall_score) AS min_score, round(sum(actual_cost), 6) AS total_cost, sum(tokens_used)::BIGINT AS tokens_used, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(actual_cost) / count(*), 6) AS avg_cost FROM assessments")
def _(v):
    return store.assessment_stats(v.assessments)


def _bins(edges):
    return " UNION ALL ".join(f"SELECT '{n}' AS band, count(*) FILTER (WHERE overall_score >= {a} AND overall_score < {b}) AS n FROM assessments" for n, a, b in edges)


@query("score_distribution", _bins(store.DISTRIBUTION))
def _(v):
    return store.binned(v.assessments, store.DISTRIBUTION)


@query("score_ranges", _bins(store.RANGES))
def _(v):
    return store.binned(v.assessments, store.RANGES)


@query("assessment_count", "SELECT count(*) AS n FROM assessments")
def _(v):
    return v.assessments.agg(F.count("*").alias("n"))


@query("companies", "SELECT DISTINCT company FROM assessments WHERE company IS NOT NULL")
def _(v):
    return store.companies(v.assessments)


@query("company_summary", "SELECT company, count(*) AS n, round(avg(overall_score), 2) AS avg_score, max(overall_score) AS max_score, min(overall_score) AS min_score, round(sum(actual_cost), 4) AS total_cost FROM assessments GROUP BY company")
def _(v):
    return store.company_summary(v.assessments)


@query("company_stats", "SELECT count(*) FILTER (WHERE overall_score >= 75) AS high, count(*) FILTER (WHERE overall_score BETWEEN 50 AND 74) AS medium, count(*) FILTER (WHERE overall_score < 50) AS low, count(*) AS total, round(avg(overall_score), 6) AS avg_score, round(sum(actual_cost), 6) AS total_cost FROM assessments WHERE company = 'BUILDING'")
def _(v):
    return store.company_stats(v.assessments, "BUILDING")


@query(
    "top_keywords",
    r"""SELECT word, count(*) AS n FROM (SELECT regexp_replace(w, '^[.,;:!?()\-]+|[.,;:!?()\-]+$', '', 'g') AS word FROM (
  SELECT unnest(regexp_split_to_array(lower(title || ' ' || summary), '\s+')) AS w FROM assessments)) WHERE length(word) > 3 AND word NOT IN ('with', 'from', 'that', 'this', 'have', 'will', 'your')
  GROUP BY word ORDER BY n DESC, word LIMIT 20""",
)
def _(v):
    return store.top_keywords(v.assessments)


@query("recommendations_summary", "SELECT recommendation, count(*) AS n FROM (SELECT unnest(from_json(recommendations, '[\"VARCHAR\"]')) AS recommendation FROM assessments WHERE json_valid(recommendations) AND json_type(recommendations) = 'ARRAY') GROUP BY 1".replace("FROM assessments WHERE json_valid(recommendations) AND json_type(recommendations) = 'ARRAY'", "FROM (SELECT CASE WHEN json_valid(recommendations) THEN recommendations END AS recommendations FROM assessments) WHERE json_type(recommendations) = 'ARRAY'"))
def _(v):
    return store.recommendations(v.assessments)


@query("pipeline_stats", "SELECT s AS status, CASE WHEN s = 'assessed' THEN (SELECT count(*) FROM assessments) ELSE (SELECT count(*) FROM reviews WHERE status = s) END AS n FROM (VALUES ('pending_review'), ('confirmed'), ('rejected'), ('assessed')) t(s)")
def _(v):
    return store.pipeline_stats(v.reviews, v.assessments)


@query(
    "job_stats",
    """SELECT 'jobs' AS metric, count(*)::DOUBLE AS value FROM jobs UNION ALL SELECT 'confirmed', count(*)::DOUBLE FROM jobs WHERE status = 'confirmed' UNION ALL SELECT 'rejected', count(*)::DOUBLE FROM jobs WHERE status = 'rejected'
  UNION ALL SELECT 'assessed', count(*)::DOUBLE FROM assessments UNION ALL SELECT 'avg_score', round(avg(overall_score), 1) FROM assessments""",
)
def _(v):
    return store.job_stats(v.jobs, v.assessments)


@query("version_stats", "SELECT coalesce(replace(preprocessing_version, 'v', ''), 'unknown') AS version, count(*) AS n FROM reviews GROUP BY 1")
def _(v):
    return store.version_stats(v.reviews)


@query("retention", "SELECT status, count(*) AS n, min(crawled_at) AS first, max(crawled_at) AS last FROM reviews GROUP BY status")
def _(v):
    return store.retention(v.reviews)


@query("top_per_company", "SELECT job_id, company, overall_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY overall_score DESC, job_id) AS rank FROM assessments) WHERE rank <= 5")
def _(v):
    return store.ranked(v.assessments.select("job_id", "company", "overall_score"), 5, "company", [F.desc("overall_score"), "job_id"])


@query("latest_line_per_key", "SELECT l_orderkey, l_linenumber, l_shipdate::VARCHAR[:10] AS shipped, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1".replace("l_shipdate::VARCHAR[:10]", "strftime(l_shipdate, '%Y-%m-%d')"), views=False)
def _(v):
    last = store.latest_per_key(v.table("lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice"])
    return last.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), "l_partkey")


@query("total_cost", "SELECT round(sum(cost), 6) AS total_cost FROM costs")
def _(v):
    return cost.total_cost(v.costs)


@query("cost_by_phase", "SELECT phase, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 6) AS total_cost FROM costs GROUP BY phase")
def _(v):
    return cost.by_phase(v.costs)


PRICES = [("small", 0.8, 4.0), ("medium", 3.0, 15.0), ("large", 15.0, 75.0)]


@query("cost_under_tier", "SELECT job_id, input_tokens, output_tokens, input_tokens / 1e6 * 3.0 + output_tokens / 1e6 * 15.0 AS call_cost FROM assessments")
def _(v):
    prices = v.spark.createDataFrame(PRICES, "tier string, input_price double, output_price double")
    return cost.priced(v.assessments.select("job_id", "input_tokens", "output_tokens"), prices, "Medium")


@query("cost_alert", "SELECT round(sum(input_tokens / 1e6 * 15.0 + output_tokens / 1e6 * 75.0), 6) AS total_cost, round(sum(input_tokens / 1e6 * 15.0 + output_tokens / 1e6 * 75.0), 6) > 0.1 AS over FROM assessments")
def _(v):
    prices = v.spark.createDataFrame(PRICES, "tier string, input_price double, output_price double")
    return cost.over_limit(cost.priced(v.assessments.select("job_id", "input_tokens", "output_tokens"), prices, "large"))


@query(
    "version_comparison",
    """SELECT *, CASE WHEN tokens_v1 > 0 AND tokens_v2 > 0 THEN tokens_v1 - tokens_v2 ELSE 0 END AS tokens_saved,
  round(CASE WHEN tokens_v1 > 0 THEN (CASE WHEN tokens_v2 > 0 THEN tokens_v1 - tokens_v2 ELSE 0 END) / tokens_v1 * 100 ELSE 0 END, 6) AS saved_percent,
  round(n_v2 * 100 / (n_v1 + n_v2), 6) AS migrated_percent, round((CASE WHEN tokens_v1 > 0 AND tokens_v2 > 0 THEN tokens_v1 - tokens_v2 ELSE 0 END) * 0.003::DOUBLE / 1e6, 9) AS saved_cost
  FROM (SELECT count(*) FILTER (WHERE preprocessing_version = 'v1.0') AS n_v1, count(*) FILTER (WHERE preprocessing_version = 'v2.0') AS n_v2,
    coalesce(sum(tokens) FILTER (WHERE preprocessing_version = 'v1.0'), 0)::BIGINT AS tokens_v1, coalesce(sum(tokens) FILTER (WHERE preprocessing_version = 'v2.0'), 0)::BIGINT AS tokens_v2,
    round(avg(tokens) FILTER (WHERE preprocessing_version = 'v1.0'), 6) AS avg_v1, round(avg(tokens) FILTER (WHERE preprocessing_version = 'v2.0'), 6) AS avg_v2 FROM reviews)""",
)
def _(v):
    return cost.version_report(v.reviews)


@query("run_metrics", "SELECT job_id, tokens_before, tokens_after, tokens_before - tokens_after AS reduction, CASE WHEN tokens_before = 0 THEN 0.0 ELSE round((tokens_before - tokens_after) / tokens_before * 100, 6) END AS reduction_percent FROM (SELECT job_id, tokens AS tokens_before, (tokens * 7) // 10 AS tokens_after FROM reviews WHERE preprocessing_version = 'v1.0')")
def _(v):
    runs = store.of_version(v.reviews, "v1.0").select("job_id", F.col("tokens").alias("tokens_before"), F.expr("tokens * 7 div 10").alias("tokens_after"))
    return cost.run_metrics(runs)


@query(
    "quality_comparison",
    """SELECT count(*) AS runs, count(*) FILTER (WHERE score_delta > 0) AS improved, count(*) FILTER (WHERE score_delta < 0) AS declined, count(*) FILTER (WHERE score_delta = 0) AS unchanged,
  greatest(max(score_delta), 0) AS max_improvement, least(min(score_delta), 0) AS max_decline, round(avg(previous_assessment_score), 6) AS avg_before, round(avg(new_assessment_score), 6) AS avg_after,
  count(*) FILTER (WHERE score_delta <= -10) AS regressions, round(count(*) FILTER (WHERE score_delta > 0) * 100 / count(*), 6) AS improved_percent, round(count(*) FILTER (WHERE score_delta < 0) * 100 / count(*), 6) AS declined_percent FROM quality""",
)
def _(v):
    return cost.quality_report(v.quality)


@query("preprocess_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE tokens IS NULL) AS failed, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT // count(*) AS avg_tokens FROM reviews")
def _(v):
    return cost.preprocess_summary(v.reviews)


def _tables(v):
    """Views with faults: postings that were rejected are gone, long assessments are there twice, some scores are too high, some ids lost."""
    jobs = v.jobs.filter("status <> 'rejected'")
    assessments = v.assessments.withColumn("overall_score", F.col("overall_score") + F.when(F.col("job_id") % 11 == 0, 60.0).otherwise(0.0))
    twice = store.repeated(assessments, F.when(F.col("output_tokens") >= 9, 2).otherwise(1)).withColumn("row_id", F.col("job_id"))
    reviews = v.reviews.withColumn("status", F.when(F.col("job_id") % 13 == 0, "rejected").otherwise(F.col("status")))
    return {"jobs": jobs, "assessments": twice, "reviews": reviews, "costs": dealt(v.costs, "job_id", v.table("lineitem")), "preprocessed": v.reviews.filter("tokens >= 500").select("job_id"), "index": twice.select("row_id", F.when(F.col("job_id") % 17 != 0, F.col("job_id")).alias("job_id"))}


FAULTS = """, fj AS (SELECT * FROM jobs WHERE status <> 'rejected'),
fa0 AS (SELECT * REPLACE (overall_score + CASE WHEN job_id % 11 = 0 THEN 60.0 ELSE 0.0 END AS overall_score) FROM assessments),
fa AS (SELECT *, job_id AS row_id FROM (SELECT * FROM fa0 UNION ALL SELECT * FROM fa0 WHERE output_tokens >= 9)),
fr AS (SELECT * REPLACE (CASE WHEN job_id % 13 = 0 THEN 'rejected' ELSE status END AS status) FROM reviews),
fc AS (SELECT * FROM costs), fp AS (SELECT job_id FROM reviews WHERE tokens >= 500),
fi AS (SELECT row_id, CASE WHEN job_id % 17 <> 0 THEN job_id END AS job_id FROM fa),
issues AS (
  SELECT 'orphaned_assessment' AS issue_type, 'error' AS severity, job_id::VARCHAR AS record_id FROM fa WHERE job_id NOT IN (SELECT id FROM fj)
  UNION ALL SELECT 'orphaned_preprocessed', 'error', job_id::VARCHAR FROM fp WHERE job_id NOT IN (SELECT id FROM fj)
  UNION ALL SELECT 'invalid_score', 'error', job_id::VARCHAR FROM fa WHERE overall_score > 100 OR tech_score > 100 OR overall_score < 0
  UNION ALL SELECT 'malformed_json', 'warning', job_id::VARCHAR FROM fa WHERE NOT json_valid(recommendations)
  UNION ALL SELECT 'missing_preprocessing', 'warning', job_id::VARCHAR FROM fa WHERE job_id NOT IN (SELECT job_id FROM fp)
  UNION ALL SELECT 'fts_data_mismatch', 'error', 'multiple' FROM fi WHERE job_id IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'duplicate_assessment', 'error', job_id::VARCHAR FROM fa GROUP BY job_id HAVING count(*) > 1
  UNION ALL SELECT 'status_inconsistency', 'warning', id::VARCHAR FROM fj JOIN fr ON id = job_id WHERE fj.status <> fr.status
  UNION ALL SELECT 'orphaned_cost_tracking', 'info', job_id::VARCHAR FROM fc WHERE job_id NOT IN (SELECT id FROM fj)
  UNION ALL SELECT 'orphaned_job_review', 'error', 'multiple' FROM fr WHERE job_id NOT IN (SELECT job_id FROM fa) HAVING count(*) > 0)
"""


@query("integrity_issues", FAULTS + "SELECT issue_type, severity, record_id FROM issues")
def _(v):
    return integrity.ordered(integrity.issues(_tables(v))).select("issue_type", "severity", "record_id")


@query("integrity_report", FAULTS + "SELECT 12 AS checks, count(*) AS issues, count(DISTINCT record_id) AS records, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM issues")
def _(v):
    return integrity.report(integrity.issues(_tables(v)))


@query("integrity_by_type", FAULTS + "SELECT issue_type, count(*) AS n, count(DISTINCT record_id) AS records FROM issues GROUP BY 1")
def _(v):
    return integrity.by_type(integrity.issues(_tables(v)))


@query("integrity_advice", FAULTS + ", advice(rank, issue_type, command) AS (VALUES " + ", ".join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(integrity.ADVICE)) + ") SELECT command, min(rank) AS rank FROM advice WHERE issue_type IN (SELECT issue_type FROM issues) GROUP BY command")
def _(v):
    return integrity.advised(integrity.issues(_tables(v)))


@query("purge_orphans", FAULTS + "SELECT job_id, overall_score FROM fa WHERE job_id IN (SELECT id FROM fj)")
def _(v):
    t = _tables(v)
    return integrity.purge_orphans(t["assessments"], t["jobs"])[0].select("job_id", "overall_score")


@query("purge_invalid_scores", FAULTS + "SELECT job_id, overall_score FROM fa WHERE NOT (overall_score > 100 OR overall_score < 0 OR tech_score > 100)")
def _(v):
    return integrity.purge_invalid_scores(_tables(v)["assessments"])[0].select("job_id", "overall_score")


@query("repair_json", FAULTS + "SELECT job_id, CASE WHEN json_valid(recommendations) THEN recommendations END AS recommendations FROM fa")
def _(v):
    return integrity.purge_malformed_json(_tables(v)["assessments"])[0].select("job_id", "recommendations")


@query("purge_by_date", "SELECT job_id, assessed_date FROM assessments WHERE NOT (assessed_date < '2001-01-01' AND assessed_date > '2000-01-01')")
def _(v):
    return integrity.purge_by_date(v.assessments, "2001-01-01", "2000-01-01")[0].select("job_id", "assessed_date")


@query("purge_range_removed", "SELECT job_id, assessed_date FROM assessments WHERE assessed_date BETWEEN '1999-01-01' AND '1999-12-31'")
def _(v):
    return integrity.purge_range(v.assessments, "1999-01-01", "1999-12-31")[1].select("job_id", "assessed_date")


@query("cascade_delete", "SELECT 'jobs' AS \"table\", count(*) FILTER (WHERE id = 77) AS n FROM jobs UNION ALL SELECT 'reviews', count(*) FILTER (WHERE job_id = 77) FROM reviews UNION ALL SELECT 'assessments', count(*) FILTER (WHERE job_id = 77) FROM assessments UNION ALL SELECT 'costs', count(*) FILTER (WHERE job_id = 77) FROM costs")
def _(v):
    return integrity.cascade({"jobs": v.jobs, "reviews": v.reviews, "assessments": v.assessments, "costs": v.costs}, 77)[1]


@query("purge_orphaned_reviews", "SELECT job_id, status FROM reviews WHERE job_id NOT IN (SELECT job_id FROM assessments)")
def _(v):
    return integrity.purge_orphaned_reviews(v.reviews, v.assessments)[1].select("job_id", "status")


_ID = "'custom:' || substr(sha256(regexp_replace(lower({c}), '\\W+', '', 'g') || '|' || regexp_replace(lower({t}), '\\W+', '', 'g') || '|' || regexp_replace(lower({l}), '\\W+', '', 'g') || '|' || regexp_replace(lower({c}), '\\W+', '', 'g')), 1, 16)"


@query("job_ids", "SELECT id, " + _ID.format(c="company", t="title", l="location") + " AS job_id FROM jobs")
def _(v):
    return v.jobs.select("id", identity.job_id(F.col("company"), F.col("title"), F.col("location")).alias("job_id"))


@query("null_id_regeneration", "SELECT title, company, location, CASE WHEN any_id IS NULL THEN " + _ID.format(c="company", t="title", l="location") + " ELSE any_id END AS job_id FROM (SELECT title, company, location, id::VARCHAR AS any_id FROM jobs WHERE id % 4 <> 0 UNION ALL SELECT DISTINCT title, company, location, NULL FROM jobs WHERE id % 4 = 0)")
def _(v):
    rows = v.jobs.select(F.col("id").alias("row_id"), "title", "company", "location", F.when(F.col("id") % 4 != 0, F.col("id").cast("string")).alias("job_id"))
    kept, _gone = integrity.regenerated_ids(rows, lambda c, t, place: identity.job_id(c, t, place))
    return kept.select("title", "company", "location", "job_id")


@query("canonical_urls", r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '') AS canonical FROM pages", views=False)
def _(v):
    return v.table("pages").select("page_id", identity.canonical_url(F.col("url")).alias("canonical"))


_URLS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://boards.greenhouse.io/x/jobs/' || (10000000 + page_id) WHEN 2 THEN 'https://x.wd5.myworkdayjobs.com/a?gh_jid=' || page_id WHEN 3 THEN 'https://jobs.LEVER.co/x/' || page_id WHEN 4 THEN 'https://x.workday.com/1234567890123456' ELSE 'https://c.example.com/123456789-x?y=1' END AS u FROM pages"


@query("portal_detection", f"SELECT page_id, CASE WHEN contains(u, 'gh_jid=') OR contains(h, 'greenhouse') THEN 'greenhouse' WHEN contains(h, 'workday') THEN 'workday' WHEN contains(h, 'lever') THEN 'lever' ELSE 'custom' END AS portal, CASE WHEN page_id % 6 = 1 THEN (10000000 + page_id)::VARCHAR WHEN page_id % 6 = 2 THEN page_id::VARCHAR WHEN page_id % 6 = 5 THEN '123456789' END AS portal_id FROM (SELECT *, lower(regexp_extract(u, '://([^/?#:]+)', 1)) AS h FROM ({_URLS}))", views=False)
def _(v):
    n = F.col("page_id")
    text = n.cast("string")
    made = F.when(n % 6 == 0, F.col("url")).when(n % 6 == 1, F.concat(F.lit("https://boards.greenhouse.io/x/jobs/"), (n + 10_000_000).cast("string"))).when(n % 6 == 2, F.concat(F.lit("https://x.wd5.myworkdayjobs.com/a?gh_jid="), text)).when(n % 6 == 3, F.concat(F.lit("https://jobs.LEVER.co/x/"), text)).when(n % 6 == 4, "https://x.workday.com/1234567890123456").otherwise("https://c.example.com/123456789-x?y=1")
    return v.table("pages").select("page_id", identity.portal(made).alias("portal"), identity.portal_id(made).alias("portal_id"))


@query("upsert_reviews", """SELECT job_id, status, crawled_at, coalesce(preprocessing_version, 'v1.0') AS preprocessing_version FROM (
  SELECT job_id, status, crawled_at, preprocessing_version FROM reviews WHERE status <> 'pending_review'
  UNION ALL SELECT job_id, 'rejected', crawled_at, NULL FROM reviews WHERE status = 'pending_review'
  UNION ALL SELECT -1 - job_id, 'rejected', '2002-01-01 00:00:00', NULL FROM reviews WHERE status = 'pending_review')""")
def _(v):
    old = v.reviews.select("job_id", "status", "crawled_at", "preprocessing_version")
    changed = old.filter("status = 'pending_review'").select("job_id", F.lit("rejected").alias("status"), F.lit("2002-01-01 00:00:00").alias("crawled_at"), F.lit(None).cast("string").alias("preprocessing_version"))
    new = changed.unionByName(changed.withColumn("job_id", -1 - F.col("job_id")))
    return mutations.upsert(old, new, keep=("crawled_at",), fallback={"preprocessing_version": "v1.0"})


@query("score_deltas", "SELECT n.job_id, n.new_score AS overall_score, trunc(a.overall_score)::BIGINT AS previous_assessment_score, trunc(n.new_score)::BIGINT - trunc(a.overall_score)::BIGINT AS score_delta FROM (SELECT job_id, overall_score + 7.5 AS new_score FROM assessments) n JOIN assessments a ON n.job_id = a.job_id")
def _(v):
    new = v.assessments.select("job_id", (F.col("overall_score") + 7.5).alias("overall_score"))
    return mutations.with_deltas(new, v.assessments)


@query("decisions", "SELECT job_id, CASE job_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'pending_review' ELSE status END AS status, CASE WHEN job_id % 4 = 1 THEN 'too far' WHEN job_id % 4 = 3 THEN reason END AS reason FROM reviews")
def _(v):
    pick = F.when(F.col("job_id") % 4 == 0, "confirm").when(F.col("job_id") % 4 == 1, "reject").when(F.col("job_id") % 4 == 2, "reset")
    decisions = v.reviews.select("job_id", pick.alias("decision"), F.lit("too far").alias("reason")).filter("decision IS NOT NULL")
    return mutations.decided(v.reviews, decisions, "2024-01-01").select("job_id", "status", "reason")


@query("status_audit", "SELECT job_id, status AS prior_status, CASE WHEN job_id % 3 = 0 THEN 'rejected' ELSE status END AS new_status FROM reviews WHERE job_id % 3 = 0 AND status <> 'rejected'")
def _(v):
    new = mutations.updated(v.reviews, F.col("job_id") % 3 == 0, status="rejected")
    return mutations.audit(v.reviews, new, F.lit("2024-01-01")).select("job_id", "prior_status", "new_status")


@query("entity_overlap", "SELECT job_id, round(CASE WHEN n = 0 THEN 100.0 ELSE hit * 100.0 / n END, 6) AS score FROM (SELECT job_id, len(w) AS n, len(list_intersect(w, ['urgent', 'machinery', 'role,', 'in', 'china'])) AS hit FROM (SELECT job_id, list_distinct(string_split(summary, ' ')) AS w FROM assessments))")
def _(v):
    from millrace.operators import scoring

    words = F.array_distinct(F.split("summary", " "))
    return v.assessments.select("job_id", F.round(scoring.overlap(F.array(*map(F.lit, ["urgent", "machinery", "role,", "in", "china"])), words), 6).alias("score"))
