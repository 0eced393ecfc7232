"""Joining context onto transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions import features as feat
from riskloom.operators.velocity import FIVE_MINUTES, velocity_running

PROFILE_FIELDS = schemas.PROFILE.fieldNames()


def rekey(df: DataFrame, key: str = "customerId") -> DataFrame:
    """Co-locate rows by key once, for callers that reuse the partitioning."""
    return df.repartition(key)


def latest_profiles(changes: DataFrame, key: str = "customerId", order: tuple[str, ...] = ("offset",)) -> DataFrame:
    """Latest value per key. ``max_by`` combines map-side, so a hot key is harmless."""
    fields = [c for c in changes.columns if c != key]
    newest = F.max_by(F.struct(*fields), F.struct(*order)).alias("_row")
    return changes.groupBy(key).agg(newest).select(key, "_row.*")


def join_profile(txn: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join on customerId; ``profile`` is null when there is none.

    No hint: Spark broadcasts the profiles only below its measured threshold
    and otherwise sort-merges, where AQE splits hot customers.
    """
    boxed = profiles.select(
        F.col("customerId").alias("_customer"), F.struct(*PROFILE_FIELDS).alias("profile")
    )
    return txn.join(boxed, txn["customerId"] == boxed["_customer"], "left").drop("_customer")


def join_velocity(txn: DataFrame, counts: DataFrame) -> DataFrame:
    """Left lookup of the latest count per customer (no time bound)."""
    latest = counts.select(F.col("customerId").alias("_customer"), "velocityCount")
    return txn.join(latest, txn["customerId"] == latest["_customer"], "left").drop("_customer")


def latest_score(predictions: DataFrame) -> DataFrame:
    """Latest model score per customer."""
    newest = F.struct("timestamp", "transactionId")
    return predictions.groupBy("customerId").agg(F.max_by("mlFraudScore", newest).alias("latestScore"))


def latest_score_lookup(txn: DataFrame, predictions: DataFrame) -> DataFrame:
    scores = latest_score(predictions).withColumnRenamed("customerId", "_customer")
    return txn.join(scores, txn["customerId"] == scores["_customer"], "left").drop("_customer")


def with_context(txn: DataFrame, profiles: DataFrame, size: str = FIVE_MINUTES) -> DataFrame:
    """Transaction, nullable profile and running velocity."""
    return join_profile(velocity_running(txn, size), profiles)


def enriched_record() -> Column:
    """The nested output record."""
    return F.struct(
        F.struct(*schemas.TRANSACTION.fieldNames()).alias("transaction"),
        F.col("profile").alias("customerProfile"),
        F.col("velocityCount"),
    )


def from_record(records: DataFrame) -> DataFrame:
    """Inverse of :func:`enriched_record` for decoded messages."""
    return records.select("transaction.*", F.col("customerProfile").alias("profile"), "velocityCount")


def flatten_enriched(featured: DataFrame) -> DataFrame:
    """Flat record handed to the panel; here a missing velocity or average is 0."""
    return featured.select(
        "transactionId", "customerId", "amount", "currency", "merchantId", "merchantCategory",
        "location", "metadata",
        F.coalesce("velocityCount", F.lit(0)).cast("long").alias("velocityCount"),
        (F.col("is_high_velocity") == 1).alias("hasHighVelocity"),
        (F.col("is_amount_unusual") == 1).alias("isAmountUnusual"),
        feat.risk_level().alias("customerRiskLevel"),
        F.when(feat.has_profile(), F.col("profile.averageTransactionAmount")).otherwise(0.0)
        .alias("customerAvgAmount"),
    )
