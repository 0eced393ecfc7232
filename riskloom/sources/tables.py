"""Domain frames read from the parquet test tables.

Each mapping is a pure projection (no join, no filter beyond the stated
business rule), so scans stay column-pruned and filters reach parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Payments from ``events``; failed attempts (``error``) look like card testing."""
    events = table(spark, folder, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    kind, k, key = F.col("event_type"), F.col("k"), F.col("event_id")
    failed = kind == "error"
    suspicious = failed | (k % 9 == 0)
    bot = (k < 10) | (failed & (k % 3 != 0))
    category = (
        F.when(kind == "purchase", "ONLINE")
        .when(kind == "view", "GROCERY")
        .when(kind == "click", "RETAIL")
        .when(kind == "signup", "RESTAURANT")
        .when(k < 80, "ONLINE")
        .otherwise("LUXURY_GOODS")
    )
    location = (
        F.when((failed & (k < 60)) | (k % 10 == 3), "Unknown Location")
        .when(k % 4 == 1, "Different Location")
        .otherwise(F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")))
    )
    return events.select(
        F.concat(F.lit("TXN-"), key.cast("string")).alias("transactionId"),
        F.concat(F.lit("CUST-"), F.col("user_id").cast("string")).alias("customerId"),
        F.col("value").alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(suspicious, F.concat(F.lit("MERCHANT-SUSPICIOUS-"), (key % 10).cast("string")))
        .otherwise(F.concat(F.lit("MERCHANT-"), (key % 1000).cast("string")))
        .alias("merchantId"),
        category.alias("merchantCategory"),
        location.alias("location"),
        F.col("ts").alias("timestamp"),
        F.struct(
            F.concat(F.when(bot, "BOT-DEVICE-").otherwise("DEVICE-"), k.cast("string")).alias("deviceId"),
            F.when(category == "ONLINE", "ONLINE").otherwise("IN_STORE").alias("channel"),
            ((k % 7 == 0) | (failed & (k % 2 == 0))).alias("rapidFire"),
            k.alias("sequence"),
            (F.col("value") > 400).alias("unusualAmount"),
        ).alias("metadata"),
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles from ``customer``; an overdrawn account has none."""
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")

    def pair(first: str, second: str):
        return F.array(F.lit(first), F.lit(second))

    return table(spark, folder, "customer").where(balance >= 0).select(
        F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("customerId"),
        F.round(balance / 25, 2).alias("averageTransactionAmount"),
        balance.alias("dailySpendingLimit"),
        F.when(segment == "AUTOMOBILE", pair("GROCERY", "GAS_STATION"))
        .when(segment == "BUILDING", pair("RETAIL", "ONLINE"))
        .when(segment == "FURNITURE", pair("RESTAURANT", "RETAIL"))
        .when(segment == "HOUSEHOLD", pair("GROCERY", "ONLINE"))
        .otherwise(pair("ONLINE", "RETAIL"))
        .alias("transactionCategories"),
        F.concat(F.lit("NATION_"), (F.col("c_custkey") % 25).cast("string")).alias("primaryLocation"),
        F.when(balance < 2000, "HIGH").when(balance < 6000, "MEDIUM").otherwise("LOW").alias("riskLevel"),
    )


def profile_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A profile changelog from ``orders``: every order restates the customer."""
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("customerId"),
        (price / 1000).alias("averageTransactionAmount"),
        (price / 50).alias("dailySpendingLimit"),
        F.when(priority.startswith("1"), "HIGH").when(priority.startswith("2"), "HIGH")
        .when(priority.startswith("3"), "MEDIUM").otherwise("LOW").alias("riskLevel"),
        F.col("o_orderdate").alias("changedAt"),
        F.col("o_orderkey").alias("offset"),
    )
