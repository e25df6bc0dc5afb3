"""Writes as functions from an old table to a new one; the caller writes the result to a new place and swaps it in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "job_id", keep: tuple[str, ...] = (), fallback: dict | None = None) -> DataFrame:
    """New rows replace old ones of the same key whole; columns in ``keep`` take the old value where there is one, those in
    ``fallback`` a default where the new value is null. Of new rows with one key the last in ``_order`` (if given) wins."""
    if "_order" in new.columns:
        new = new.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_order")))).filter("_rank = 1").drop("_rank", "_order")
    for name, value in (fallback or {}).items():
        new = new.withColumn(name, F.coalesce(name, F.lit(value)))
    if keep:
        before = old.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in keep])
        new = new.join(before, key, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns if c in new.columns])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_deltas(new: DataFrame, old: DataFrame) -> DataFrame:
    """Assessments with score_delta: the new score, cut to a whole number, less the previous one; null without one."""
    before = old.select("job_id", F.col("overall_score").cast("long").alias("previous_assessment_score"))
    out = new.drop("previous_assessment_score", "score_delta").join(before, "job_id", "left")
    return out.withColumn("score_delta", F.col("overall_score").cast("long") - F.col("previous_assessment_score"))


def updated(df: DataFrame, matched: Column, **values) -> DataFrame:
    """``df`` with columns set where ``matched`` holds."""
    return df.withColumns({c: F.when(matched, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, keys: DataFrame, key: str = "job_id") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def audit(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Audit rows of status changes: a posting whose new status differs from its old one."""
    both = new.select("job_id", F.col("status").alias("new_status")).join(old.select("job_id", F.col("status").alias("prior_status"), F.col("reviewed_at").alias("prior_reviewed_at")), "job_id")
    changed = both.filter("NOT (new_status <=> prior_status)")
    return changed.select(F.sha2(F.concat_ws("|", F.col("job_id").cast("string"), "prior_status", "new_status", at.cast("string")), 256).alias("audit_id"), "job_id", "prior_status", "new_status", "prior_reviewed_at", at.alias("reviewed_at"))


def decided(reviews: DataFrame, decisions: DataFrame, at: str) -> DataFrame:
    """Reviews after decisions (job_id, decision, reason): confirm, reject with a reason, or back to pending_review."""
    out = reviews.join(decisions.select("job_id", "decision", F.col("reason").alias("_reason")), "job_id", "left")
    status = F.when(F.col("decision") == "confirm", "confirmed").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "reset", "pending_review").otherwise(F.col("status"))
    reason = F.when(F.col("decision") == "reject", F.col("_reason")).when(F.col("decision").isNotNull(), None).otherwise(F.col("reason"))
    stamp = F.when(F.col("decision").isNotNull(), F.lit(at)).otherwise(F.col("reviewed_at"))
    return out.withColumns({"status": status, "reason": reason, "reviewed_at": stamp}).drop("decision", "_reason")


def review_summary(decisions: DataFrame) -> DataFrame:
    """(decision, n, percent): whole percents of all decisions."""
    counts = decisions.groupBy("decision").agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).select("decision", "n", F.floor(F.col("n") * 100 / F.col("_all")).alias("percent"))


def confirmed(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.lit("confirmed"))


def backfilled_versions(df: DataFrame) -> DataFrame:
    """Rows without a preprocessing version get the first one."""
    return df.withColumn("preprocessing_version", F.coalesce("preprocessing_version", F.lit("v1.0")))
