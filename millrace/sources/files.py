"""JSON, CSV, Markdown and text files of postings, selectors and reports."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import schemas

COMPANIES = "companies map<string, struct<enabled: boolean, name: string, url: string, selectors: map<string, string>>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which goes when the JVM ends; in local mode without one a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def companies(spark: SparkSession, path: str) -> DataFrame:
    """(company, enabled, name, url, selectors, file) of one JSON file or a folder of them; of a company in several files the last file, by name, wins.

    Bad files of a folder are passed over; a single bad file fails.
    """
    one = path.endswith(".json")
    read = spark.read.schema(COMPANIES).option("multiLine", True).option("mode", "FAILFAST" if one else "DROPMALFORMED").json(path)
    rows = read.filter("companies IS NOT NULL").select(F.explode("companies").alias("company", "c"), F.col("_metadata.file_name").alias("file")).select("company", "c.*", "file")
    rank = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("file")))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def enabled_companies(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Companies to crawl; an error if there is none."""
    out = companies(spark, path).filter("enabled")
    if only is not None:
        out = out.filter(F.lower("company") == only.lower())
    if out.isEmpty():
        raise ValueError(f"no enabled company in {path}")
    return out


def postings(spark: SparkSession, folder: str, pattern: str = "*_jobs.json") -> tuple[DataFrame, DataFrame]:
    """(good, bad) postings of the files that match a pattern, those named preprocessed aside; a row that isn't one is bad."""
    read = spark.read.schema(f"{schemas.JOBS}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(folder)
    named = read.withColumn("file", F.col("_metadata.file_name")).filter(~F.col("file").contains("preprocessed"))
    lost = F.col("_corrupt_record").isNotNull() | F.col("title").isNull()
    return named.filter(~lost).drop("_corrupt_record"), named.filter(lost).select("file", "_corrupt_record")


def landed(pages: DataFrame, extract: Callable[[Column], Column], most: int | None = None) -> DataFrame:
    """Postings from landed pages (company, url, html): extract gives a struct (title, location, link); pages without a title are dropped.

    With ``most``, that many pages of each company, in order of their address.
    """
    rows = pages.withColumn("_e", extract(F.col("html"))).filter(F.coalesce(F.col("_e.title"), F.lit("")) != "")
    out = rows.select("company", F.col("_e.title").alias("title"), F.coalesce(F.nullif(F.col("_e.location"), F.lit("")), F.lit("Not specified")).alias("location"), absolute(F.col("url"), F.col("_e.link")).alias("url"), "html")
    if most is not None:
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy("company").orderBy("url"))).filter(F.col("_rank") <= most).drop("_rank")
    return out


def absolute(base: Column, link: Column) -> Column:
    """Address of a link on a page."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.when(link.isNull() | (link == ""), base).when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), link))


def with_details(lists: DataFrame, details: DataFrame) -> DataFrame:
    """List pages enriched by their detail pages (url, description), where there are any."""
    more = details.select("url", F.col("description").alias("_more")).dropDuplicates(["url"])
    out = lists.join(more, "url", "left")
    now = F.col("description") if "description" in lists.columns else F.lit(None)
    return out.withColumn("description", F.coalesce("_more", now)).drop("_more")


def profile(spark: SparkSession, path: str) -> DataFrame:
    """One row (profile): the whole text of a file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("profile"))


def write_postings(df: DataFrame, path: str) -> None:
    """JSON files, a folder for each company."""
    df.withColumn("company", F.lower("company")).repartition("company").write.mode("overwrite").partitionBy("company").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> int:
    """Rows written, with a header; the count is made while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["n"]


def write_issues(issues: DataFrame, path: str) -> None:
    """CSV files, a folder for each type of issue."""
    issues.write.mode("overwrite").partitionBy("issue_type").option("header", True).csv(path)


def write_text(report: DataFrame, path: str) -> None:
    """A report of one row and one text column."""
    report.coalesce(1).write.mode("overwrite").text(path)


def metric_rows(one: DataFrame) -> DataFrame:
    """(metric, value) of a one-row report."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in one.columns)
    return one.select(F.expr(f"stack({len(one.columns)}, {pairs}) AS (metric, value)"))
