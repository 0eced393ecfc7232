"""Pairing feedback with predictions, and what follows from a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import text as tx


def union_tagged(predictions: DataFrame, feedback: DataFrame, tag: str = "topic") -> DataFrame:
    """Two inputs read as one, tagged by origin."""
    return predictions.withColumn(tag, F.lit("ml-predictions")).unionByName(
        feedback.withColumn(tag, F.lit("analyst-feedback")), allowMissingColumns=True
    )


def within(left: str, right: str, seconds: int) -> Column:
    gap = F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return (F.col(right) >= F.col(left) - gap) & (F.col(right) <= F.col(left) + gap)


def pair(predictions: DataFrame, feedback: DataFrame, seconds: int | None = S.PAIRING_SECONDS) -> DataFrame:
    """Inner join on transactionId; either side may come first.

    Batch jobs pass ``seconds=None`` and pair all feedback, however late. With a
    bound, ``predictedAt`` and ``feedbackAt`` limit the pair in time, which is
    what lets the streaming form drop state. Columns present on both sides are
    taken from the feedback.
    """
    shared = set(predictions.columns) & set(feedback.columns) - {"transactionId"}
    right = feedback.withColumnRenamed("transactionId", "_txn")
    condition = F.col("transactionId") == F.col("_txn")
    if seconds is not None:
        condition = condition & within("predictedAt", "feedbackAt", seconds)
    return predictions.drop(*shared).join(right, condition, "inner").drop("_txn")


def should_embed(threshold: float = S.MIN_EMBED_CONFIDENCE) -> Column:
    """A person's label decides; without one, a confident fraud prediction."""
    actual = F.col("actualFraud")
    confident = F.round(F.coalesce("confidence", F.lit(0.0)), 4) >= threshold
    return (
        F.when(actual, True).when(~actual, False)
        .otherwise(F.coalesce("predictedFraud", F.lit(False)) & confident)
    )


def not_cold_start(velocity: Column, score: Column) -> Column:
    return ~((velocity <= S.COLD_START_VELOCITY) & (score < S.COLD_START_SCORE))


def review_outcome() -> Column:
    actual = F.col("actualFraud")
    return (
        F.when(actual, "CONFIRMED_FRAUD").when(~actual, "FALSE_POSITIVE")
        .when(F.col("predictedFraud"), "CONFIRMED_FRAUD").otherwise("LEGITIMATE")
    )


def confidence_level() -> Column:
    value = F.coalesce("confidence", F.lit(0.0))
    return F.when(value >= 0.8, "HIGH").when(value >= 0.6, "MEDIUM").otherwise("LOW")


def confirmed_by() -> Column:
    return F.when(F.col("actualFraud").isNotNull(), "human_analyst").otherwise("system")


def case_review_record(feedback: DataFrame, review_id: Column | None = None) -> DataFrame:
    """Review rows for all feedback, whether or not the case is stored."""
    return feedback.select(
        (F.xxhash64("transactionId") if review_id is None else review_id).alias("id"),
        F.col("transactionId").alias("transaction_id"),
        F.coalesce("analystId", F.lit("system")).alias("analyst_id"),
        review_outcome().alias("review_outcome"),
        tx.join_text("Pattern: ", F.coalesce("fraudPattern", F.lit("unknown")), ", Confidence: ",
                     tx.fixed(F.coalesce("confidence", F.lit(0.0)), 2)).alias("notes"),
        F.col("reviewTimeSeconds").alias("time_to_review_seconds"),
        F.col("feedbackAt").alias("reviewed_at"),
        F.lit(None).cast("long").alias("fraud_decision_id"),
        F.struct("fraudPattern", "predictedFraud", "actualFraud", "confidence").alias("evidence_sources"),
        confidence_level().alias("confidence_level"),
    )


def with_prediction_score(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every feedback row, with the score of its prediction where there is one."""
    scores = predictions.select(F.col("transactionId").alias("_txn"), "mlFraudScore")
    return feedback.drop("mlFraudScore").join(scores, F.col("transactionId") == F.col("_txn"), "left").drop("_txn")


def resolve_label(feedback: DataFrame) -> DataFrame:
    """A person's label when present, else the system's own prediction."""
    actual = F.col("actualFraud")
    return feedback.withColumns({
        "label": F.coalesce(actual, F.col("predictedFraud"), F.lit(False)).cast("int"),
        "labelSource": F.when(actual.isNotNull(), "HUMAN_CONFIRMED").otherwise("AUTO_PREDICTED"),
    })


ONLINE_FEATURES = ["confidence", "agent_consensus", "ml_fraud_score", "source_auto"]


def feedback_features() -> dict[str, Column]:
    """The online model's inputs; a missing score reads as 0.5."""
    return {
        "confidence": F.coalesce("confidence", F.lit(0.5)),
        "agent_consensus": F.coalesce("agentConsensus", F.lit(0)).cast("double"),
        "ml_fraud_score": F.coalesce("mlFraudScore", F.lit(0.5)),
        "source_auto": F.when(F.col("source") == "AUTO_SYSTEM", 1.0).otherwise(0.0),
    }
