"""Transaction velocity: tumbling counts, latest count, running count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.operators.ordered import running_totals

FIVE_MINUTES = "5 minutes"


def velocity_windows(txn: DataFrame, size: str = FIVE_MINUTES) -> DataFrame:
    """Count per customer and tumbling window; combines map-side before the shuffle."""
    return (
        txn.groupBy("customerId", F.window("timestamp", size).alias("w"))
        .agg(F.count(F.lit(1)).alias("velocityCount"))
        .select("customerId", F.col("w.start").alias("windowStart"), F.col("w.end").alias("windowEnd"),
                "velocityCount")
    )


def current_velocity(windows: DataFrame) -> DataFrame:
    """Latest count per customer: the last window wins, nothing expires."""
    return windows.groupBy("customerId").agg(
        F.max_by("velocityCount", "windowStart").alias("velocityCount"),
        F.max("windowStart").alias("windowStart"),
    )


def velocity_running(txn: DataFrame, size: str = FIVE_MINUTES, split: str | None = None) -> DataFrame:
    """``velocityCount``: the customer's payments so far in the current window.

    Keyed by (customer, window), so even a customer with a third of all rows
    is spread over its windows, and a group is bounded by what one customer pays
    in one window. ``split`` cuts long windows of busy customers into parts of
    that length, at the price of a second shuffle.
    """
    keyed = txn.withColumn("_window", F.window("timestamp", size)["start"])
    return running_totals(
        keyed, ["customerId", "_window"], ["timestamp", "transactionId"],
        {"velocityCount": F.lit(1).cast("long")},
        ranges=None if split is None else F.window("timestamp", split)["start"],
    ).drop("_window")


def velocity_lagged(txn: DataFrame, size: str = FIVE_MINUTES) -> DataFrame:
    """The stale reading: the count before this row was added."""
    return velocity_running(txn, size).withColumn("velocityCount", F.col("velocityCount") - 1)


def velocity_alert(enriched: DataFrame, limit: int = S.VELOCITY_ALERT) -> DataFrame:
    """Rows whose count is strictly above the alert limit."""
    return enriched.where(F.col("velocityCount") > limit)
