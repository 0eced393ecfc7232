"""The monitoring feed: joined records, buckets and headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import text as tx
from riskloom.functions.numbers import rounded
from riskloom.operators.analytics import tally

# Bucket labels (plain words; a display may decorate them).
FRAUD, REVIEW, APPROVED = "FRAUD", "REVIEW", "APPROVED"


def feed_bucket() -> Column:
    fraud = F.coalesce("predictedFraud", F.lit(False))
    return F.when(fraud & (F.col("confidence") >= S.ALERT_CONFIDENCE), FRAUD).when(fraud, REVIEW).otherwise(APPROVED)


def display_pattern() -> Column:
    own = F.nullif(F.nullif(F.col("fraudPattern"), F.lit("")), F.lit("unknown"))
    top = F.when(F.col("casesFound") > 0, F.col("topCasePattern"))
    return F.coalesce(own, top, F.lit(tx.DASH))


def feed_records(paired: DataFrame) -> DataFrame:
    """Display records from paired predictions and feedback.

    Expects casesFound, topSimilarity and topCasePattern beside the pair.
    """
    found = F.coalesce("casesFound", F.lit(0))
    return paired.select(
        F.col("feedbackAt").alias("time"),
        "transactionId",
        F.right("transactionId", F.lit(8)).alias("txnShort"),
        F.coalesce("customerId", F.lit(tx.DASH)).alias("customerId"),
        rounded(F.coalesce("mlFraudScore", F.lit(0.0)) * 100, 1).alias("mlScorePct"),
        found.cast("int").alias("ragCases"),
        F.when(found > 0, rounded(F.col("topSimilarity") * 100, 1)).otherwise(0.0).alias("topSimilarityPct"),
        display_pattern().alias("topPattern"),
        F.coalesce("agentConsensus", F.lit(0)).cast("int").alias("agents"),
        rounded(F.coalesce("confidence", F.lit(0.0)) * 100, 1).alias("confidencePct"),
        feed_bucket().alias("decision"),
    )


def rolling_feed(records: DataFrame, limit: int = S.FEED_SIZE) -> DataFrame:
    return records.orderBy(F.desc("time"), F.desc("transactionId")).limit(limit)


def headline_metrics(records: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    base = F.greatest(total, F.lit(1))
    counts = {name: F.coalesce(tally(F.col("decision") == name), F.lit(0)) for name in (FRAUD, REVIEW, APPROVED)}
    hits = F.coalesce(tally(F.col("ragCases") > 0), F.lit(0))
    return records.agg(
        total.alias("totalProcessed"),
        counts[FRAUD].alias("fraudCount"), counts[REVIEW].alias("reviewCount"),
        counts[APPROVED].alias("approvedCount"), hits.alias("ragHitCount"),
        rounded(counts[FRAUD] / base * 100, 1).alias("fraudRatePct"),
        rounded(hits / base * 100, 1).alias("ragHitRatePct"),
    )


def context_impact(records: DataFrame) -> DataFrame:
    """With-context and cold-start figures, coverage, delta and top pattern in one row."""
    used = F.col("ragCases") > 0
    by_pattern = records.groupBy("topPattern").agg(
        F.count(F.lit(1)).alias("n"), tally(used).alias("n_with"),
        *[F.sum(F.when(side, F.col(name))).alias(f"{name}_{tag}")
          for tag, side in (("with", used), ("without", ~used))
          for name in ("confidencePct", "topSimilarityPct", "ragCases")],
    )
    n, n_with = F.sum("n"), F.sum("n_with")
    n_without = n - n_with

    def mean(name: str, tag: str) -> Column:
        return F.try_divide(F.sum(f"{name}_{tag}"), n_with if tag == "with" else n_without)

    named = (F.col("topPattern") != tx.DASH) & (F.col("n_with") > 0)
    ranked = F.when(named, F.struct("n_with", F.col("topPattern")))
    return by_pattern.agg(
        n_without.alias("coldCount"),
        rounded(mean("confidencePct", "without"), 1).alias("coldAvgConfidence"),
        n_with.alias("contextCount"),
        rounded(mean("confidencePct", "with"), 1).alias("contextAvgConfidence"),
        rounded(mean("topSimilarityPct", "with"), 1).alias("contextAvgSimilarity"),
        rounded(mean("ragCases", "with"), 1).alias("contextAvgCases"),
        rounded(F.try_divide(n_with * 100.0, n), 1).alias("coveragePct"),
        rounded(mean("confidencePct", "with") - mean("confidencePct", "without"), 1).alias("confidenceDelta"),
        F.max(ranked)["topPattern"].alias("topPattern"),
    )
