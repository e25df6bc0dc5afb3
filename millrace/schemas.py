"""Table schemas, and alignment of a DataFrame with one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOBS = "id string, title string, company string, location string, url string, description string, requirements array<string>, salary_min double, salary_max double, posted_date string, crawled_at string, status string"
REVIEWS = "job_id string, title string, location string, company string, status string, reason string, tokens long, estimated_cost double, crawled_at string, preprocessed_at string, reviewed_at string, preprocessing_version string"
ASSESSMENTS = "job_id string, title string, company string, location string, overall_score double, tech_score double, seniority_score double, location_score double, recommendations string, summary string, tokens_used long, input_tokens long, output_tokens long, actual_cost double, assessed_date string, preprocessing_version string, preprocessing_quality_check boolean, previous_assessment_score long, score_delta long"
COSTS = "id long, job_id string, phase string, input_tokens long, output_tokens long, cost double, timestamp string, preprocessing_version_before string, preprocessing_version_after string, tokens_before long, tokens_after long, estimated_cost_before double, estimated_cost_after double, is_re_preprocessing boolean"
QUALITY = "id long, job_id string, preprocessing_version_before string, preprocessing_version_after string, previous_assessment_score long, new_assessment_score long, score_delta long, timestamp string"
AUDIT = "audit_id string, job_id string, prior_status string, new_status string, prior_reviewed_at string, reviewed_at string, re_review_reason string"
ISSUES = "issue_type string, severity string, table string, record_id string, details string, suggested_action string"

STATUSES = ("pending_review", "confirmed", "rejected")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def align_to(df: DataFrame, ddl: str, defaults: dict | None = None) -> DataFrame:
    """``df`` with exactly the columns of a schema: absent ones as a default or null, present ones cast, others dropped."""
    defaults = defaults or {}
    wanted = schema(ddl)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in wanted])


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` renamed to ``new`` if it is there; where both are, values of ``new`` win and ``old`` goes."""
    if old not in df.columns:
        return df
    if new not in df.columns:
        return df.withColumnRenamed(old, new)
    return df.withColumn(new, F.coalesce(new, old)).drop(old)
