"""Twelve integrity checks, their report, and purges as functions from old tables to new ones.

A check returns issues (issue_type, severity, table, record_id, details, suggested_action); a purge returns (kept, removed)
and writes nothing, so that a dry run is to look at ``removed`` alone. No list of ids goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORES = ("overall_score", "tech_score", "seniority_score", "location_score")
#: Purges that answer an issue, in the order in which they are advised.
ADVICE = [
    ("orphaned_assessment", "purge orphaned assessments"),
    ("orphaned_preprocessed", "purge orphaned preprocessed"),
    ("invalid_score", "purge invalid scores"),
    ("malformed_json", "repair malformed json"),
    ("fts_orphan", "rebuild index"),
    ("fts_data_mismatch", "rebuild index"),
    ("duplicate_assessment", "purge duplicates"),
    ("null_job_id", "regenerate ids"),
    ("orphaned_job_review", "purge orphaned reviews"),
]


def issue(df: DataFrame, kind: str, severity: str, table: str, record_id: Column, details: Column, action: str) -> DataFrame:
    return df.select(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(table).alias("table"), record_id.cast("string").alias("record_id"), details.alias("details"), F.lit(action).alias("suggested_action"))


def orphans(df: DataFrame, parents: DataFrame, key: str = "job_id", parent_key: str = "id") -> DataFrame:
    """Rows without a parent; a null key has none."""
    return df.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def orphaned_assessments(assessments: DataFrame, jobs: DataFrame) -> DataFrame:
    return issue(orphans(assessments, jobs), "orphaned_assessment", "error", "job_assessments", F.col("job_id"), F.lit("no such posting"), "delete it")


def orphaned_preprocessed(preprocessed: DataFrame, jobs: DataFrame) -> DataFrame:
    return issue(orphans(preprocessed, jobs), "orphaned_preprocessed", "error", "preprocessed_jobs", F.col("job_id"), F.lit("no such posting"), "delete it")


def out_of_range(names: tuple[str, ...] = SCORES) -> Column:
    """Names and values of the scores outside 0 to 100, as an array; nulls are in range."""
    return F.array_compact(F.array(*[F.when((F.col(n) < 0) | (F.col(n) > 100), F.concat(F.lit(f"{n}="), F.format_string("%.2f", F.col(n)))) for n in names]))


def invalid_scores(assessments: DataFrame) -> DataFrame:
    marked = assessments.withColumn("_bad", out_of_range()).filter(F.size("_bad") > 0)
    return issue(marked, "invalid_score", "error", "job_assessments", F.col("job_id"), F.concat_ws(", ", "_bad"), "delete it")


def is_json(text: Column) -> Column:
    """Whether a text is JSON, without anything after it. NaN and infinities aren't."""
    # a value followed by more text parses too, but not as the element of an array
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(text).isNotNull()


def malformed_json(assessments: DataFrame) -> DataFrame:
    bad = assessments.filter(F.col("recommendations").isNotNull() & ~is_json(F.col("recommendations")))
    return issue(bad, "malformed_json", "warning", "job_assessments", F.col("job_id"), F.lit("recommendations are no JSON"), "set them to null")


def missing_preprocessing(assessments: DataFrame, preprocessed: DataFrame) -> DataFrame:
    return issue(orphans(assessments, preprocessed, parent_key="job_id"), "missing_preprocessing", "warning", "job_assessments", F.col("job_id"), F.lit("assessed without preprocessing"), "process it again")


def index_orphans(index: DataFrame, assessments: DataFrame) -> DataFrame:
    """One issue that says how many index rows have no base row, if any."""
    lost = index.join(assessments.select("row_id"), "row_id", "left_anti").agg(F.count("*").alias("n")).filter("n > 0")
    return issue(lost, "fts_orphan", "info", "job_assessments_fts", F.lit("multiple"), F.concat(F.col("n").cast("string"), F.lit(" rows without an assessment")), "rebuild the index")


def index_mismatch(index: DataFrame) -> DataFrame:
    lost = index.agg(F.count_if(F.col("job_id").isNull()).alias("n")).filter("n > 0")
    return issue(lost, "fts_data_mismatch", "error", "job_assessments_fts", F.lit("multiple"), F.concat(F.col("n").cast("string"), F.lit(" rows without an id")), "rebuild the index")


def duplicates(assessments: DataFrame) -> DataFrame:
    """One issue for each id that several assessments have; null counts as an id."""
    many = assessments.groupBy("job_id").agg(F.count("*").alias("n")).filter("n > 1")
    return issue(many, "duplicate_assessment", "error", "job_assessments", F.col("job_id"), F.concat(F.col("n").cast("string"), F.lit(" assessments")), "keep one")


def inconsistent_status(jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    both = jobs.select("id", F.col("status").alias("a")).join(reviews.select(F.col("job_id").alias("id"), F.col("status").alias("b")), "id").filter("b IS NOT NULL AND NOT (a <=> b)")
    return issue(both, "status_inconsistency", "warning", "jobs", F.col("id"), F.concat(F.coalesce("a", F.lit("none")), F.lit(" but reviewed "), F.col("b")), "take the review's")


def orphaned_costs(costs: DataFrame, jobs: DataFrame) -> DataFrame:
    return issue(orphans(costs, jobs), "orphaned_cost_tracking", "info", "cost_tracking", F.col("job_id"), F.lit("no such posting"), "keep it for totals")


def null_ids(assessments: DataFrame) -> DataFrame:
    lost = assessments.agg(F.count_if(F.col("job_id").isNull()).alias("n")).filter("n > 0")
    return issue(lost, "null_job_id", "error", "job_assessments", F.lit("NULL"), F.concat(F.col("n").cast("string"), F.lit(" assessments without an id")), "regenerate ids")


def orphaned_reviews(reviews: DataFrame, assessments: DataFrame) -> DataFrame:
    """Up to two issues: reviews without an id, and distinct ids that have no assessment."""
    nulls = reviews.agg(F.count_if(F.col("job_id").isNull()).alias("n")).filter("n > 0")
    lost = reviews.filter("job_id IS NOT NULL").join(assessments.select("job_id"), "job_id", "left_anti").agg(F.countDistinct("job_id").alias("n")).filter("n > 0")
    say = lambda df, text, who: issue(df, "orphaned_job_review", "error", "job_reviews", F.lit(who), F.concat(F.col("n").cast("string"), F.lit(text)), "delete them")
    return say(nulls, " reviews without an id", "NULL").unionByName(say(lost, " reviews without an assessment", "multiple"))


def checks(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    """The checks, in their order, that the tables at hand allow."""
    rules: list[tuple[Callable[..., DataFrame], tuple[str, ...]]] = [
        (orphaned_assessments, ("assessments", "jobs")),
        (orphaned_preprocessed, ("preprocessed", "jobs")),
        (invalid_scores, ("assessments",)),
        (malformed_json, ("assessments",)),
        (missing_preprocessing, ("assessments", "preprocessed")),
        (index_orphans, ("index", "assessments")),
        (index_mismatch, ("index",)),
        (duplicates, ("assessments",)),
        (inconsistent_status, ("jobs", "reviews")),
        (orphaned_costs, ("costs", "jobs")),
        (null_ids, ("assessments",)),
        (orphaned_reviews, ("reviews", "assessments")),
    ]
    return [rule(*[tables[n] for n in names]) for rule, names in rules if all(n in tables for n in names)]


def assessment_issues(assessments: DataFrame, jobs: DataFrame, preprocessed: DataFrame) -> DataFrame:
    """What the four checks of single assessments give (orphans, scores, JSON, missing preprocessing), from one pass: the parents'
    keys are joined on the same key, and each row says what is wrong with it."""
    keys = lambda df, key, name: df.select(F.col(key).alias("job_id")).distinct().withColumn(name, F.lit(True))
    rows = assessments.select("job_id", *SCORES, "recommendations")
    marked = rows.join(keys(jobs, "id", "_job"), "job_id", "left").join(keys(preprocessed, "job_id", "_ready"), "job_id", "left").withColumn("_bad", out_of_range())
    text = F.col("recommendations")

    def found(condition: Column, kind: str, severity: str, details: Column, action: str) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit("job_assessments").alias("table"), F.col("job_id").cast("string").alias("record_id"), details.alias("details"), F.lit(action).alias("suggested_action")))

    wrong = F.array_compact(
        F.array(
            found(F.col("_job").isNull(), "orphaned_assessment", "error", F.lit("no such posting"), "delete it"),
            found(F.size("_bad") > 0, "invalid_score", "error", F.concat_ws(", ", "_bad"), "delete it"),
            found(text.isNotNull() & ~is_json(text), "malformed_json", "warning", F.lit("recommendations are no JSON"), "set them to null"),
            found(F.col("_ready").isNull(), "missing_preprocessing", "warning", F.lit("assessed without preprocessing"), "process it again"),
        )
    )
    return marked.select(F.explode(wrong).alias("i")).select("i.*")


def issues(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All issues; checks that ask of the same rows share a pass over them."""
    whole = dict(tables)
    if {"assessments", "jobs", "preprocessed"} <= whole.keys():
        shared = assessment_issues(whole["assessments"], whole["jobs"], whole["preprocessed"])
        rest = [orphaned_preprocessed(whole["preprocessed"], whole["jobs"])]
        # of the others only ids are read
        ids = whole["assessments"].select(*[c for c in ("row_id", "job_id") if c in whole["assessments"].columns])
        others: list[tuple[Callable[..., DataFrame], tuple[str, ...]]] = [(index_orphans, ("index", "assessments")), (index_mismatch, ("index",)), (duplicates, ("assessments",)), (inconsistent_status, ("jobs", "reviews")), (orphaned_costs, ("costs", "jobs")), (null_ids, ("assessments",)), (orphaned_reviews, ("reviews", "assessments"))]
        rest += [rule(*[{**whole, "assessments": ids}[n] for n in names]) for rule, names in others if all(n in whole for n in names)]
        return reduce(DataFrame.unionByName, rest, shared)
    return reduce(DataFrame.unionByName, checks(whole))


def report(found: DataFrame) -> DataFrame:
    """One row: issues, records affected, and counts of the severities."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(F.lit(12).alias("checks"), F.count("*").alias("issues"), F.countDistinct("record_id").alias("records"), count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))


def by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("issue_type").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"))


def ordered(found: DataFrame) -> DataFrame:
    """Errors first, then warnings and notes; by type and record within."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    # a sort asks for a sample of its rows first: they are dealt before it, so that the checks run once and not for the sample too
    return found.repartition("issue_type", "record_id").orderBy(rank, "issue_type", "record_id")


def advised(found: DataFrame) -> DataFrame:
    """(rank, command) for the types at hand, each command once."""
    table = found.sparkSession.createDataFrame([(i, t, c) for i, (t, c) in enumerate(ADVICE)], "rank int, issue_type string, command string")
    # a type at hand once: a join of all issues by their few types would put each type's in one task
    return table.join(found.select("issue_type").distinct(), "issue_type", "left_semi").groupBy("command").agg(F.min("rank").alias("rank")).orderBy("rank")


Purge = tuple[DataFrame, DataFrame]


def split(df: DataFrame, condition: Column) -> Purge:
    """Rows for which a condition doesn't hold (or is unknown), and those for which it does."""
    held = F.coalesce(condition, F.lit(False))
    return df.filter(~held), df.filter(held)


def purge_orphans(df: DataFrame, parents: DataFrame, key: str = "job_id", parent_key: str = "id") -> Purge:
    known = parents.select(F.col(parent_key).alias(key))
    return df.join(known, key, "left_semi"), df.join(known, key, "left_anti")


def purge_invalid_scores(assessments: DataFrame) -> Purge:
    return split(assessments, F.size(out_of_range()) > 0)


def purge_malformed_json(assessments: DataFrame) -> Purge:
    """All rows, with recommendations null where they are no JSON; and the rows that were so."""
    bad = F.col("recommendations").isNotNull() & ~is_json(F.col("recommendations"))
    return assessments.withColumn("recommendations", F.when(~bad, F.col("recommendations"))), assessments.filter(bad)


def purge_by_date(df: DataFrame, before: str | None = None, after: str | None = None, time: str = "assessed_date") -> Purge:
    """Rows strictly before and after two moments go; without any moment none."""
    if before is None and after is None:
        return df, df.limit(0)
    condition = F.lit(True)
    if before is not None:
        condition = condition & (F.col(time) < before)
    if after is not None:
        condition = condition & (F.col(time) > after)
    return split(df, condition)


def purge_range(df: DataFrame, start: str, end: str, time: str = "assessed_date") -> Purge:
    """Rows of a closed range of texts; an end without a time leaves that day's moments."""
    return split(df, F.col(time).between(start, end))


def cascade(tables: Mapping[str, DataFrame], job_id) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without a posting's rows, and (table, n) of what goes; nothing does for an unknown posting."""
    keys = {name: "id" if name == "jobs" else "job_id" for name in tables}
    kept = {name: df.filter(~F.coalesce(F.col(keys[name]) == job_id, F.lit(False))) for name, df in tables.items()}
    counts = [df.filter(F.col(keys[name]) == job_id).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return kept, reduce(DataFrame.unionByName, counts)


def purge_orphaned_reviews(reviews: DataFrame, assessments: DataFrame) -> Purge:
    """Reviews without an id or an assessment go."""
    return purge_orphans(reviews, assessments, parent_key="job_id")


def rebuilt_index(assessments: DataFrame) -> DataFrame:
    return assessments.select("row_id", "job_id", "title", "company", "summary", "recommendations")


def regenerated_ids(assessments: DataFrame, make: Callable[[Column, Column, Column], Column], order: str = "row_id") -> Purge:
    """Rows without an id get one from company, title and location; later ones of the same three go."""
    nulls = assessments.filter("job_id IS NULL")
    rank = F.row_number().over(Window.partitionBy("title", "company", "location").orderBy(order))
    marked = nulls.withColumn("_rank", rank)
    made = make(F.coalesce("company", F.lit("Unknown")), F.coalesce("title", F.lit("Unknown")), F.coalesce("location", F.lit("Not specified")))
    fixed = marked.filter("_rank = 1").drop("_rank").withColumn("job_id", made)
    return assessments.filter("job_id IS NOT NULL").unionByName(fixed), marked.filter("_rank > 1").drop("_rank")
