"""Costs, versions and quality runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price of saved tokens in version reports, in USD for each million.
SAVED_PRICE = 0.003


def total_cost(costs: DataFrame) -> DataFrame:
    return costs.agg(F.round(F.sum("cost"), 6).alias("total_cost"))


def by_phase(costs: DataFrame) -> DataFrame:
    return costs.groupBy("phase").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("total_cost")).orderBy(F.desc("total_cost"), "phase")


def call_cost(input_tokens: Column, output_tokens: Column, input_price: Column | float, output_price: Column | float) -> Column:
    """USD of a call, from prices for a million tokens."""
    price = lambda p: p if isinstance(p, Column) else F.lit(float(p))
    return input_tokens / F.lit(1e6) * price(input_price) + output_tokens / F.lit(1e6) * price(output_price)


def priced(df: DataFrame, prices: DataFrame, tier: str) -> DataFrame:
    """``df`` with the cost of each row under a tier of a price table (tier, input_price, output_price); an unknown tier fails."""
    row = prices.filter(F.lower("tier") == tier.lower()).select("input_price", "output_price").limit(1)
    joined = df.crossJoin(F.broadcast(row))  # one row
    return joined.withColumn("call_cost", call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"), F.col("output_price"))).drop("input_price", "output_price")


def over_limit(df: DataFrame, limit: float = 0.10) -> DataFrame:
    """One row (total_cost, over)."""
    return df.agg(F.round(F.coalesce(F.sum("call_cost"), F.lit(0.0)), 6).alias("total_cost")).withColumn("over", F.col("total_cost") > limit)


def version_report(reviews: DataFrame) -> DataFrame:
    """One row comparing the two preprocessing versions; savings only where both have tokens."""
    v = F.col("preprocessing_version")
    one = reviews.agg(
        F.count_if(v == "v1.0").alias("n_v1"), F.count_if(v == "v2.0").alias("n_v2"),
        F.coalesce(F.sum(F.when(v == "v1.0", F.col("tokens"))), F.lit(0)).alias("tokens_v1"), F.coalesce(F.sum(F.when(v == "v2.0", F.col("tokens"))), F.lit(0)).alias("tokens_v2"),
    )
    avg = lambda k: F.coalesce(F.try_divide(F.col(f"tokens_{k}"), F.col(f"n_{k}")), F.lit(0.0))
    one = one.withColumns({"avg_v1": F.round(avg("v1"), 6), "avg_v2": F.round(avg("v2"), 6)})
    both = (F.col("tokens_v1") > 0) & (F.col("tokens_v2") > 0)
    one = one.withColumn("tokens_saved", F.when(both, F.col("tokens_v1") - F.col("tokens_v2")).otherwise(0))
    return one.withColumns(
        {
            "saved_percent": F.round(F.when(F.col("tokens_v1") > 0, F.col("tokens_saved") / F.col("tokens_v1") * 100).otherwise(0.0), 6),
            "migrated_percent": F.round(F.coalesce(F.try_divide(F.col("n_v2") * 100, F.col("n_v1") + F.col("n_v2")), F.lit(0.0)), 6),
            "saved_cost": F.round(F.col("tokens_saved") * SAVED_PRICE / 1e6, 9),
        }
    )


def run_metrics(runs: DataFrame) -> DataFrame:
    """Runs (tokens_before, tokens_after) with reduction and reduction_percent."""
    return runs.withColumns({"reduction": F.col("tokens_before") - F.col("tokens_after"), "reduction_percent": F.when(F.col("tokens_before") == 0, 0.0).otherwise(F.round((F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before") * 100, 6))})


def quality_report(quality: DataFrame) -> DataFrame:
    """One row: improved, declined and unchanged runs, extremes and averages."""
    d = F.col("score_delta")
    one = quality.agg(
        F.count("*").alias("runs"), F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("declined"), F.count_if(d == 0).alias("unchanged"),
        F.greatest(F.coalesce(F.max(d), F.lit(0)), F.lit(0)).alias("max_improvement"), F.least(F.coalesce(F.min(d), F.lit(0)), F.lit(0)).alias("max_decline"),
        F.round(F.avg("previous_assessment_score"), 6).alias("avg_before"), F.round(F.avg("new_assessment_score"), 6).alias("avg_after"), F.count_if(d <= -10).alias("regressions"),
    )
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100, F.col("runs")), F.lit(0.0)), 6)
    return one.withColumns({"improved_percent": rate("improved"), "declined_percent": rate("declined")})


def regression_risk(quality: DataFrame, threshold: int = -10, limit: int = 100) -> DataFrame:
    """Runs that lost as much or more, the worst first."""
    return quality.filter(F.col("score_delta") <= threshold).orderBy("score_delta", "job_id").limit(limit)


def preprocess_summary(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("total"), F.count_if(F.col("tokens").isNull()).alias("failed"), F.sum("tokens").alias("tokens"), F.expr("sum(tokens) div count(*)").alias("avg_tokens"))
