"""Three-way routing of decisions and the payload of each output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S

ALERT, REVIEW, APPROVED = S.ROUTES


def predicates() -> dict[str, Column]:
    """Condition of each route but the last; confident fraud, then fraud or mid confidence."""
    fraud, confidence = F.col("isFraudulent"), F.col("confidenceScore")
    uncertain = (confidence > S.REVIEW_LOW) & (confidence < S.REVIEW_HIGH)
    return {ALERT: fraud & (confidence > S.ALERT_CONFIDENCE), REVIEW: fraud | uncertain}


def route(conditions: dict[str, Column] | None = None, otherwise: str = APPROVED) -> Column:
    """First match wins, in the order given; what matches nothing goes to ``otherwise``."""
    chosen = F
    for name, condition in (predicates() if conditions is None else conditions).items():
        chosen = chosen.when(condition, F.lit(name))
    return F.lit(otherwise) if chosen is F else chosen.otherwise(F.lit(otherwise))


def with_route(decisions: DataFrame, conditions: dict[str, Column] | None = None, otherwise: str = APPROVED) -> DataFrame:
    return decisions.withColumn("route", route(conditions, otherwise))


def split(decisions: DataFrame, conditions: dict[str, Column] | None = None, otherwise: str = APPROVED) -> dict[str, DataFrame]:
    """Disjoint, complete parts; each is a filter on the one route column."""
    routed = with_route(decisions, conditions, otherwise)
    names = S.ROUTES if conditions is None else dict.fromkeys([*conditions, otherwise])
    return {name: routed.where(F.col("route") == name) for name in names}


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("long")


def audit_decision(confidence: Column, legacy: bool = False) -> Column:
    """BLOCK / REVIEW / APPROVE; ``legacy`` keeps the old constant outcome."""
    if legacy:
        return F.lit("APPROVE")
    return F.when(confidence >= 0.8, "BLOCK").when(confidence >= 0.6, "REVIEW").otherwise("APPROVE")


def _now() -> Column:
    return F.unix_millis(F.current_timestamp())


def _agents() -> Column:
    return F.size("agentInsights")


def alert_payload(decisions: DataFrame, now: Column | None = None) -> DataFrame:
    return decisions.select(
        F.lit("AI_FRAUD_ALERT").alias("type"), "transactionId",
        percent(F.col("confidenceScore")).alias("confidence"), "fraudPattern",
        F.col("primaryReason").alias("reason"), _agents().alias("agentCount"),
        F.col("detailedExplanation").alias("aiExplanation"),
        (_now() if now is None else now).alias("timestamp"),
        F.when(F.col("confidenceScore") >= S.ALERT_CONFIDENCE, "HIGH").otherwise("MEDIUM").alias("priority"),
    )


def review_payload(decisions: DataFrame, now: Column | None = None) -> DataFrame:
    return decisions.select(
        F.lit("AI_REVIEW_CASE").alias("type"), "transactionId",
        percent(F.col("confidenceScore")).alias("confidence"), "fraudPattern",
        F.col("detailedExplanation").alias("explanation"), "agentInsights",
        F.lit("PENDING_HUMAN_REVIEW").alias("status"),
        (_now() if now is None else now).alias("timestamp"),
    )


def approval_payload(decisions: DataFrame, now: Column | None = None) -> DataFrame:
    return decisions.select(
        F.lit("AI_APPROVAL").alias("type"), "transactionId",
        percent(F.col("confidenceScore")).alias("confidence"),
        F.lit("APPROVED_BY_AI").alias("status"), _agents().alias("agentCount"),
        (_now() if now is None else now).alias("timestamp"),
    )


def feedback_record(decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """Automatic feedback for every decision; ``actualFraud`` stays absent until a person adds it."""
    return decisions.select(
        "transactionId", F.col("isFraudulent").alias("predictedFraud"),
        F.col("confidenceScore").alias("confidence"), "fraudPattern",
        _agents().alias("agentConsensus"), (_now() if now is None else now).alias("timestamp"),
        F.lit("AUTO_SYSTEM").alias("source"),
    )


PAYLOADS = {ALERT: alert_payload, REVIEW: review_payload, APPROVED: approval_payload}
