"""Seeded faults: each check finds its own fault and nothing else."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import identity
from millrace.operators import integrity, mutations

A = "row_id long, job_id string, title string, company string, location string, overall_score double, tech_score double, seniority_score double, location_score double, recommendations string"


def assessments(spark, *rows):
    good = (1, "a", "T", "C", "L", 70.0, 70.0, 70.0, 70.0, '["x"]')
    return spark.createDataFrame([good, *rows], A)


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame([("a", "confirmed"), ("b", "rejected")], "id string, status string")


def ids(df):
    return sorted(r["record_id"] or "~" for r in df.collect())


def test_orphans_and_null_keys(spark, jobs):
    rows = assessments(spark, (2, "z", "T", "C", "L", 1.0, 1.0, 1.0, 1.0, None), (3, None, "T", "C", "L", 1.0, 1.0, 1.0, 1.0, None))
    assert ids(integrity.orphaned_assessments(rows, jobs)) == ["z", "~"]
    kept, gone = integrity.purge_orphans(rows, jobs)
    assert (kept.count(), gone.count()) == (1, 2)


@pytest.mark.parametrize(("score", "found"), [(-1.0, 1), (0.0, 0), (100.0, 0), (101.0, 1), (None, 0)])
def test_invalid_scores(spark, score, found):
    rows = assessments(spark, (2, "b", "T", "C", "L", score, 1.0, 1.0, 1.0, None))
    assert integrity.invalid_scores(rows).count() == found
    assert integrity.purge_invalid_scores(rows)[0].count() == 2 - found


@pytest.mark.parametrize(("text", "bad"), [("[", 1), ('{"a": 1} x', 1), ("[1] [2]", 1), ('"s"', 0), ("[]", 0), ("", 1), (None, 0)])
def test_malformed_json(spark, text, bad):
    rows = assessments(spark, (2, "b", "T", "C", "L", 1.0, 1.0, 1.0, 1.0, text))
    assert integrity.malformed_json(rows).count() == bad
    assert integrity.purge_malformed_json(rows)[0].filter("recommendations IS NULL").count() == bad + (text is None)


def test_duplicates_count_null_as_an_id(spark):
    none = (2, None, "T", "C", "L", 1.0, 1.0, 1.0, 1.0, None)
    assert ids(integrity.duplicates(assessments(spark, none, none))) == ["~"]


def test_status_and_reviews(spark, jobs):
    reviews = spark.createDataFrame([("a", "rejected"), ("b", "rejected"), ("c", None), (None, "confirmed")], "job_id string, status string")
    assert ids(integrity.inconsistent_status(jobs, reviews)) == ["a"]
    assert ids(integrity.orphaned_reviews(reviews, assessments(spark))) == ["NULL", "multiple"]


def test_report_and_advice(spark, jobs):
    rows = assessments(spark, (2, "z", "T", "C", "L", 200.0, 1.0, 1.0, 1.0, "["))
    found = integrity.issues({"assessments": rows, "jobs": jobs})
    one = integrity.report(found).first()
    assert (one["issues"], one["records"], one["errors"], one["warnings"]) == (3, 1, 2, 1)
    assert [r["command"] for r in integrity.advised(found).collect()] == ["purge orphaned assessments", "purge invalid scores", "repair malformed json"]


def test_purge_by_date_is_strict_and_none_is_none(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), (None,)], "assessed_date string")
    assert integrity.purge_by_date(rows)[1].count() == 0
    assert integrity.purge_by_date(rows, before="2024-01-02")[1].count() == 1
    assert integrity.purge_by_date(rows, before="2024-01-02", after="2024-01-01")[1].count() == 0
    assert integrity.purge_range(rows, "2024-01-01", "2024-01-02")[1].count() == 2


def test_regenerated_ids(spark):
    none = [(i, None, "T", "C", None, 1.0, 1.0, 1.0, 1.0, None) for i in (5, 6)]
    kept, gone = integrity.regenerated_ids(assessments(spark, *none), lambda c, t, place: identity.job_id(c, t, place))
    assert gone.count() == 1 and kept.filter("job_id IS NULL").count() == 0 and kept.filter("job_id LIKE 'custom:%'").count() == 1


def test_cascade_of_unknown_id(spark, jobs):
    kept, counts = integrity.cascade({"jobs": jobs}, "nope")
    assert kept["jobs"].count() == 2 and counts.first()["n"] == 0


def test_upsert_keeps_and_falls_back(spark):
    old = spark.createDataFrame([("a", "x", "v2.0"), ("b", "y", "v2.0")], "job_id string, crawled_at string, version string")
    new = spark.createDataFrame([("a", "z", None), ("c", "w", None)], "job_id string, crawled_at string, version string")
    got = {r["job_id"]: (r["crawled_at"], r["version"]) for r in mutations.upsert(old, new, keep=("crawled_at",), fallback={"version": "v1.0"}).collect()}
    assert got == {"a": ("x", "v1.0"), "b": ("y", "v2.0"), "c": ("w", "v1.0")}


def test_audit_only_changes(spark):
    old = spark.createDataFrame([("a", "confirmed", None), ("b", "rejected", "t")], "job_id string, status string, reviewed_at string")
    new = old.withColumn("status", F.lit("rejected"))
    assert [r["job_id"] for r in mutations.audit(old, new, F.lit("now")).collect()] == ["a"]
