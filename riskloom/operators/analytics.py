"""Aggregate views over the audit tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(condition: Column) -> Column:
    """Conditional count as a sum, so groups without a match give 0."""
    return F.sum(F.when(condition, 1).otherwise(0))


def fraud_summary_by_pattern(decisions: DataFrame) -> DataFrame:
    return (
        decisions.where(F.col("fraud_pattern").isNotNull())
        .groupBy("fraud_pattern")
        .agg(
            F.count(F.lit(1)).alias("total_cases"),
            F.avg("ml_score").alias("avg_ml_score"),
            F.avg("llm_confidence").alias("avg_llm_confidence"),
            tally(F.col("decision") == "BLOCK").alias("blocked_count"),
            tally(F.col("decision") == "REVIEW").alias("review_count"),
            tally(F.col("rag_context_used")).alias("rag_assisted_count"),
            F.min("decided_at").alias("first_seen"),
            F.max("decided_at").alias("last_seen"),
        )
        .orderBy(F.desc("total_cases"), "fraud_pattern")
    )


def analyst_performance(reviews: DataFrame) -> DataFrame:
    outcome = F.col("review_outcome")
    return (
        reviews.where(F.col("analyst_id").isNotNull())
        .groupBy("analyst_id")
        .agg(
            F.count(F.lit(1)).alias("total_reviews"),
            F.avg("time_to_review_seconds").alias("avg_review_time_sec"),
            tally(outcome == "CONFIRMED_FRAUD").alias("confirmed_fraud"),
            tally(outcome == "FALSE_POSITIVE").alias("false_positives"),
            tally(outcome == "ESCALATED").alias("escalated"),
            F.min("reviewed_at").alias("first_review"),
            F.max("reviewed_at").alias("last_review"),
        )
        .orderBy(F.desc("total_reviews"), "analyst_id")
    )


def model_performance(predictions: DataFrame) -> DataFrame:
    correct = F.col("prediction_correct")
    return (
        predictions.groupBy("model_type")
        .agg(
            F.count(F.lit(1)).alias("total_predictions"),
            F.avg("prediction_score").alias("avg_score"),
            F.avg("prediction_time_ms").alias("avg_latency_ms"),
            F.try_divide(tally(correct).cast("double"), tally(correct.isNotNull())).alias("accuracy"),
            F.min("predicted_at").alias("first_prediction"),
            F.max("predicted_at").alias("last_prediction"),
        )
        .orderBy("model_type")
    )


def summary_counts(**tables: DataFrame) -> DataFrame:
    """One row with the row count of each table, from one-row partial counts."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, df in tables.items()]
    united = reduce(DataFrame.unionByName, counts)
    return united.agg(*[F.sum(F.when(F.col("t") == name, F.col("n"))).alias(f"total_{name}") for name in tables])


def decision_distribution(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("decision").isNotNull()).groupBy("decision").agg(F.count(F.lit(1)).alias("count"))


def top_patterns(decisions: DataFrame, limit: int = 10) -> DataFrame:
    return (
        decisions.where(F.col("fraud_pattern").isNotNull())
        .groupBy(F.col("fraud_pattern").alias("pattern"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "pattern")
        .limit(limit)
    )
