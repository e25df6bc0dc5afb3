"""Views of the test tables as postings, reviews, assessments, costs and quality runs, in Spark and as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.partitions import dealt, spread

STAMP = "yyyy-MM-dd HH:mm:ss"


class Views:
    """The domain's tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are dear to work on."""
        return spread(self.table(name))

    @cached_property
    def jobs(self) -> DataFrame:
        """Orders as postings."""
        orders = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("rejected")
        return orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("company"), F.col("n_name").alias("location"),
            F.date_format("o_orderdate", STAMP).alias("crawled_at"), status.alias("status"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """Reviews of the postings."""
        status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("rejected")
        orders = self.table("orders").join(self.table("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        return orders.select(
            F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("company"), status.alias("status"),
            F.when(F.col("o_orderstatus") == "P", F.lit("not a fit")).alias("reason"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("tokens"),
            F.date_format("o_orderdate", STAMP).alias("crawled_at"), F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add("o_orderdate", 3), STAMP)).alias("reviewed_at"),
            F.when(F.col("o_orderkey") % 3 == 0, "v1.0").otherwise("v2.0").alias("preprocessing_version"),
        )

    @cached_property
    def assessments(self) -> DataFrame:
        """Line items of an order as its assessment."""
        lines = dealt(self.table("lineitem"), "l_orderkey").groupBy("l_orderkey").agg(
            F.round(F.avg("l_quantity") * 2, 6).alias("overall_score"), (F.max("l_quantity") * 2).alias("tech_score"), (F.min("l_quantity") * 2).alias("seniority_score"),
            (F.count("*") * 100).alias("tokens_used"), F.sum("l_quantity").cast("long").alias("input_tokens"), F.count("*").alias("output_tokens"),
            F.round(F.sum("l_extendedprice") / 1e6, 8).alias("actual_cost"), F.date_format(F.max("l_shipdate"), STAMP).alias("assessed_date"), F.max("l_returnflag").alias("flag"),
        )
        jobs = self.jobs.select(F.col("id").alias("job_id"), "title", "company", "location")
        joined = lines.join(jobs, F.col("l_orderkey") == F.col("job_id"))
        text = F.when(F.col("job_id") % 7 == 0, '["broken').when(F.col("job_id") % 5 == 0, '"only text"').otherwise(F.concat(F.lit('["learn '), "flag", F.lit('", "apply"]')))
        summary = F.concat_ws(" ", F.lower("title"), F.lower("company"), F.lit("role, in"), F.lower("location"))
        return joined.select("job_id", "title", "company", "location", "overall_score", "tech_score", "seniority_score", F.lit(50.0).alias("location_score"), text.alias("recommendations"), summary.alias("summary"), "tokens_used", "input_tokens", "output_tokens", "actual_cost", "assessed_date")

    @cached_property
    def costs(self) -> DataFrame:
        """Line items as cost entries."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("phase"), F.col("l_quantity").cast("long").alias("input_tokens"), F.col("l_linenumber").cast("long").alias("output_tokens"), (F.col("l_extendedprice") / 1e6).alias("cost"))

    @cached_property
    def quality(self) -> DataFrame:
        """Smallest and largest quantities of an order as scores before and after."""
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg((F.min_by("l_quantity", F.struct("l_shipdate", "l_quantity")) * 2).cast("long").alias("previous_assessment_score"), (F.max_by("l_quantity", F.struct("l_shipdate", "l_quantity")) * 2).cast("long").alias("new_assessment_score"), F.date_format(F.max("l_shipdate"), STAMP).alias("timestamp")).withColumn("score_delta", F.col("new_assessment_score") - F.col("previous_assessment_score"))


#: The same views for DuckDB; a query's SQL begins with it.
SQL = """
WITH jobs AS (
  SELECT o_orderkey AS id, o_orderpriority AS title, c_mktsegment AS company, n_name AS location, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS crawled_at,
    CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending_review' ELSE 'rejected' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
reviews AS (
  SELECT o_orderkey AS job_id, o_orderpriority AS title, c_mktsegment AS company,
    CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending_review' ELSE 'rejected' END AS status,
    CASE WHEN o_orderstatus = 'P' THEN 'not a fit' END AS reason, floor(o_totalprice / 100)::BIGINT AS tokens, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS crawled_at,
    CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate::DATE + 3, '%Y-%m-%d 00:00:00') END AS reviewed_at,
    CASE WHEN o_orderkey % 3 = 0 THEN 'v1.0' ELSE 'v2.0' END AS preprocessing_version
  FROM orders JOIN customer ON o_custkey = c_custkey),
assessments AS (
  SELECT job_id, title, company, location, overall_score, tech_score, seniority_score, 50.0::DOUBLE AS location_score,
    CASE WHEN job_id % 7 = 0 THEN '["broken' WHEN job_id % 5 = 0 THEN '"only text"' ELSE '["learn ' || flag || '", "apply"]' END AS recommendations,
    lower(title) || ' ' || lower(company) || ' role, in ' || lower(location) AS summary, tokens_used, input_tokens, output_tokens, actual_cost, assessed_date
  FROM (SELECT l_orderkey AS job_id, round(avg(l_quantity) * 2, 6) AS overall_score, max(l_quantity) * 2 AS tech_score, min(l_quantity) * 2 AS seniority_score, (count(*) * 100)::BIGINT AS tokens_used,
      sum(l_quantity)::BIGINT AS input_tokens, count(*)::BIGINT AS output_tokens, round(sum(l_extendedprice) / 1e6, 8) AS actual_cost, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS assessed_date, max(l_returnflag) AS flag
    FROM lineitem GROUP BY 1) JOIN (SELECT id AS jid, title, company, location FROM jobs) ON job_id = jid),
costs AS (SELECT l_orderkey AS job_id, l_returnflag AS phase, l_quantity::BIGINT AS input_tokens, l_linenumber::BIGINT AS output_tokens, l_extendedprice / 1e6 AS cost FROM lineitem),
quality AS (
  SELECT *, new_assessment_score - previous_assessment_score AS score_delta FROM (
    SELECT l_orderkey AS job_id, (arg_min(l_quantity, (l_shipdate, l_quantity)) * 2)::BIGINT AS previous_assessment_score, (arg_max(l_quantity, (l_shipdate, l_quantity)) * 2)::BIGINT AS new_assessment_score,
      strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS "timestamp" FROM lineitem GROUP BY 1))
"""
