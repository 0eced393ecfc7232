"""Readers for message streams and audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.sources import messages

# Stream names.
TOPICS = {
    "transactions": "transactions", "profiles": "customerProfiles", "enriched": "enriched-transactions",
    "predictions": "ml-predictions", "decisions": "fraud-decisions", "feedback": "analyst-feedback",
}


def read_messages(spark: SparkSession, path: str, *, streaming: bool = True, start: str = "earliest",
                  files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines as a ``value`` column, from files.

    ``start="latest"`` takes the newest files first; a file source has no
    notion of skipping what was there before.
    """
    if not streaming:
        return spark.read.text(path)
    reader = spark.readStream.format("text").option("latestFirst", str(start == "latest").lower())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, *, start: str = "earliest",
               rows_per_trigger: int | None = None) -> DataFrame:
    """The same from a broker (needs the connector on the classpath)."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", start)
    )
    if rows_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", rows_per_trigger)
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def read_transactions(spark: SparkSession, path: str, fmt: str = "json", *, streaming: bool = True,
                      **options) -> tuple[DataFrame, DataFrame | None]:
    """(valid, quarantine) from JSON lines, or typed rows from parquet (no quarantine)."""
    if fmt == "parquet":
        reader = spark.readStream if streaming else spark.read
        return reader.schema(schemas.TRANSACTION).parquet(path), None
    return messages.decode_transactions(read_messages(spark, path, streaming=streaming, **options))


def read_audit(spark: SparkSession, folder: str, table: str, newest_first: str | None = None,
               limit: int | None = None, **equals) -> DataFrame:
    """An audit table with equality filters, optional order and limit; filters reach the files."""
    rows = spark.read.schema(schemas.AUDIT[table]).parquet(f"{folder}/{table}")
    for column, value in equals.items():
        rows = rows.where(F.col(column) == F.lit(value))
    if newest_first:
        rows = rows.orderBy(F.desc(newest_first))
    return rows if limit is None else rows.limit(limit)
