"""Markdown reports of assessments and issues. A report is one text and so made of a bounded number of rows; ask for a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def card(df: DataFrame) -> DataFrame:
    """(job_id, overall_score, card): a section of Markdown for each assessment."""
    advice = F.coalesce(F.from_json("recommendations", "array<string>"), F.array().cast("array<string>"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.coalesce("title", F.lit("Unknown")), F.lit(" at "), F.coalesce("company", F.lit("Unknown"))),
        F.concat(F.lit("- Score: "), F.format_string("%.1f", "overall_score")),
        F.concat(F.lit("- Location: "), F.coalesce("location", F.lit("Not specified"))),
        F.when(F.size(advice) > 0, F.concat(F.lit("- Advice: "), F.array_join(advice, "; "))),
        F.col("summary"),
    )
    return df.select("job_id", "overall_score", text.alias("card"))


def analytics(df: DataFrame) -> DataFrame:
    """One row: average, extremes, bands and the share of input tokens."""
    s = F.col("overall_score")
    return df.agg(
        F.count("*").alias("n"), F.bround(F.avg(s), 1).alias("avg_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.count_if(s >= 75).alias("high"), F.count_if((s >= 50) & (s < 75)).alias("medium"), F.count_if(s < 50).alias("low"),
        F.round(F.try_divide(F.sum("input_tokens") * 100.0, F.sum(F.col("input_tokens") + F.col("output_tokens"))), 1).alias("input_percent"),
    )


def markdown(df: DataFrame, title: str = "Assessments", limit: int = 10) -> DataFrame:
    """One row (report): the best assessments and the figures of all."""
    best = card(df).orderBy(F.desc("overall_score"), "job_id").limit(limit)
    cards = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("overall_score")).alias("s"), "job_id", "card"))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: x["card"]), "\n\n")
    figures = F.format_string("%d assessments, average %.1f, from %.1f to %.1f; %d high, %d medium, %d low", "n", "avg_score", "min_score", "max_score", "high", "medium", "low")
    return cards.crossJoin(analytics(df)).select(F.concat_ws("\n\n", F.lit(f"# {title}"), F.lit(f"## Top {limit}"), body, F.lit("## Figures"), figures).alias("report"))


def issue_report(issues: DataFrame) -> DataFrame:
    """One row (report): counts of the issues by severity and type, the most severe first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    rows = issues.groupBy("severity", "issue_type").agg(F.count("*").alias("n")).withColumn("rank", rank)
    lines = rows.agg(F.array_sort(F.collect_list(F.struct("rank", "issue_type", F.format_string("- %s: %s (%d)", "severity", "issue_type", "n").alias("line")))).alias("l"))
    return lines.select(F.concat_ws("\n", F.lit("# Integrity"), F.lit(""), F.when(F.size("l") == 0, F.lit("No issues.")).otherwise(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))).alias("report"))
