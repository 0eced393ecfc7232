"""Decoding JSON messages into typed rows, with a quarantine for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas

CORRUPT = "_corrupt"
PREVIEW_CHARACTERS = 200


def decode(df: DataFrame, schema: T.StructType, required: list[str], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid rows opened into columns, quarantined rows with reasons).

    A message that does not parse, or lacks a required field (a mistyped field
    reads as absent), is set aside with its whole text, which can be
    replayed, and a preview of 200 characters; it never fails the job.
    """
    wider = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    text = F.col(column).cast("string")
    parsed = F.from_json(text, wider, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # A one-row generator keeps the parse in one place: as a plain column it is copied into every use of a field.
    opened = df.select("*", F.explode(F.array(parsed)).alias("_message"))

    def field(path: str) -> Column:
        return F.col(f"_message.{path}")

    missing = F.array_compact(F.array(*[
        F.when(field(p).isNull(), F.lit(p.replace(".", "_") + "_missing")) for p in required]))
    nothing = F.col("_message").isNull() | F.forall(
        F.array(*[field(p).isNull() for p in required]), lambda absent: absent)
    # A truncated message may still yield its leading fields; it is malformed all the same.
    cut_short = field(CORRUPT).isNotNull() & F.try_parse_json(text).isNull()
    reasons = F.when(nothing | cut_short, F.array(F.lit("malformed"))).otherwise(missing)
    marked = opened.withColumn("reasons", reasons)
    kept = [c for c in df.columns if c != column]
    valid = marked.where(F.size("reasons") == 0).select(*kept, *[field(c).alias(c) for c in schema.fieldNames()])
    quarantine = marked.where(F.size("reasons") > 0).select(
        *kept, "reasons", text.alias("raw"), F.substring(text, 1, PREVIEW_CHARACTERS).alias("preview"))
    return valid, quarantine


# The fields each message must carry.
TRANSACTION_FIELDS = ["transactionId", "customerId", "amount", "currency", "merchantId", "merchantCategory",
                      "location", "timestamp", "metadata"]
PROFILE_FIELDS = schemas.PROFILE.fieldNames()
PREDICTION_FIELDS = ["transactionId"]
FEEDBACK_FIELDS = ["transactionId"]
DECISION_FIELDS = ["transactionId", "isFraudulent", "confidenceScore"]


def decode_transactions(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    return decode(df, schemas.TRANSACTION, TRANSACTION_FIELDS, column)


def decode_enriched(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    return decode(df, schemas.ENRICHED, [f"transaction.{f}" for f in TRANSACTION_FIELDS], column)


def decode_profiles(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    return decode(df, schemas.PROFILE, PROFILE_FIELDS, column)


def decode_predictions(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    return decode(df, schemas.PREDICTION, PREDICTION_FIELDS, column)


def decode_feedback(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    return decode(df, schemas.FEEDBACK, FEEDBACK_FIELDS, column)


def decode_decisions(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    return decode(df, schemas.DECISION, DECISION_FIELDS, column)


def encode(df: DataFrame, key: str, value: Column | None = None) -> DataFrame:
    """(key, value) messages: the key column and the row as JSON."""
    body = F.to_json(F.struct("*")) if value is None else F.to_json(value)
    return df.select(F.col(key).cast("string").alias("key"), body.alias("value"))
