"""Files and streams."""

import json

import pytest

from millrace import schemas
from millrace.plans import batch
from millrace.sources import files
from millrace.streaming import events
from tests.conftest import SMALL


def test_companies_last_file_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"companies": {"X": {"url": "1"}, "Y": {"url": "2", "enabled": False}}}))
    (tmp_path / "b.json").write_text(json.dumps({"companies": {"X": {"url": "3"}}}))
    got = {r["company"]: (r["url"], r["enabled"]) for r in files.companies(spark, str(tmp_path)).collect()}
    assert got == {"X": ("3", True), "Y": ("2", False)}
    with pytest.raises(ValueError):
        files.enabled_companies(spark, str(tmp_path), only="y")


def test_postings_and_sinks(spark, tmp_path):
    (tmp_path / "x_jobs.json").write_text(json.dumps([{"id": "1", "title": "T", "company": "X"}, {"id": "2"}]))
    (tmp_path / "preprocessed_jobs.json").write_text(json.dumps([{"id": "3", "title": "T"}]))
    good, bad = files.postings(spark, str(tmp_path))
    assert [r["id"] for r in good.collect()] == ["1"] and bad.count() == 1
    assert files.write_csv(good.select("id", "title"), str(tmp_path / "csv")) == 1
    files.write_postings(good.select("id", "title", "company"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["company"] == "x"


def test_align_and_rename(spark):
    df = spark.createDataFrame([(1, "x")], "id int, crawled_date string")
    out = schemas.align_to(schemas.renamed(df, "crawled_date", "crawled_at"), "id string, crawled_at string, status string", {"status": "pending_review"})
    assert out.first().asDict() == {"id": "1", "crawled_at": "x", "status": "pending_review"}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(str(folder))
    seen = {}
    query = events.into(events.once(events.stream(spark, str(folder)), "40 days"), lambda df, n: seen.__setitem__(n, df.count()), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sum(seen.values()) == spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").distinct().count()


def test_batch_phases(spark):
    jobs = spark.createDataFrame([("1", "Dev", "X", "Here", "https://a.b/c", "<p>Python is required. Leadership.</p>"), (None, "Ops", "Y", None, None, None)], "id string, title string, company string, location string, url string, description string")
    profile = spark.createDataFrame([(["leadership"], ["python"], ["x"])], "skills array<string>, technologies array<string>, requirements array<string>")
    ready = {r["title"]: r for r in batch.run(jobs, up_to="preprocess").collect()}
    assert ready["Dev"]["technologies"] == ["python"] and ready["Dev"]["skills"] == ["leadership"] and ready["Ops"]["job_id"].startswith("custom:")
    decisions = spark.createDataFrame([("1", "confirm", None)], "job_id string, decision string, reason string")
    assert [r["title"] for r in batch.run(jobs, decisions, profile, "assess").collect()] == ["Dev"]
    assert "Dev at X" in batch.run(jobs, decisions, profile).first()["report"]
    with pytest.raises(ValueError):
        batch.run(jobs, up_to="nope")


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
