"""The store of confirmed cases and the context built from retrieved ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import feedback as fb


KEPT_KIND = ("array<struct<rank:int,similarity:double,text:string,fraudPattern:string,confidence:double,"
             "confirmedBy:string,embeddedAt:string,transactionId:string>>")


def confirmed_cases(paired: DataFrame, embedded_at: Column | None = None) -> DataFrame:
    """Cases worth storing from paired feedback: id, document, metadata.

    One row per transaction: repeated feedback for the same id collapses with
    partial aggregation, so a hot id is cheap.
    """
    moment = F.current_timestamp() if embedded_at is None else embedded_at
    kept = paired.where(
        fb.should_embed() & fb.not_cold_start(F.col("velocity_count"), F.col("mlFraudScore"))
    )
    rows = kept.select(
        F.col("transactionId").alias("id"),
        F.col("feedbackAt").alias("_at"),
        tx.case_text().alias("document"),
        F.struct(
            "transactionId", "customerId", "fraudPattern", "confidence", "mlFraudScore",
            F.col("velocity_count").cast("int").alias("velocityCount"),
            F.col("is_high_velocity").cast("int").alias("isHighVelocity"),
            F.col("is_bot_device").cast("int").alias("isBotDevice"),
            F.col("is_suspicious_merchant").cast("int").alias("isSuspiciousMerchant"),
            fb.confirmed_by().alias("confirmedBy"),
            F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss").alias("embeddedAt"),
        ).alias("metadata"),
    )
    first = F.min_by(F.struct("document", "metadata"), F.struct("_at", "document")).alias("_row")
    return rows.groupBy("id").agg(first).select("id", "_row.*")


def insert_if_absent(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def case_pattern_counts(cases: DataFrame) -> DataFrame:
    pattern = F.coalesce("metadata.fraudPattern", F.lit("unknown")).alias("fraudPattern")
    return cases.groupBy(pattern).agg(F.count(F.lit(1)).alias("cases"))


def case_store_stats(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("totalCases"))


def kept_cases(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Gather each query's kept hits, in rank order, with their case fields.

    At most ``keep`` hits exist per query, so the gathered array is bounded.
    """
    details = cases.select(F.col("id").alias("caseId"), F.col("document").alias("text"), "metadata")
    row = F.struct(
        "rank", "similarity", "text", "metadata.fraudPattern", "metadata.confidence",
        "metadata.confirmedBy", "metadata.embeddedAt", "metadata.transactionId",
    )
    return (
        hits.join(details, "caseId", "left")
        .groupBy("queryId")
        .agg(F.sort_array(F.collect_list(row)).alias("cases"))
    )


def rag_context(cases: Column) -> Column:
    """Context struct carried on a prediction; the empty form when nothing was kept."""
    found = F.coalesce(cases, F.array().cast(KEPT_KIND))
    summary = F.transform(found, lambda c: F.struct(
        c["similarity"].alias("similarity"), c["fraudPattern"].alias("fraudPattern"),
        c["confidence"].alias("confidence"), c["confirmedBy"].alias("confirmedBy"),
        F.substring(c["text"], 1, 200).alias("summary"),
    ))
    return F.struct(
        F.size(found).alias("casesFound"),
        summary.alias("cases"),
        tx.case_block(found).alias("promptContext"),
    )


def max_similarity(context: Column) -> Column:
    """Best similarity in a context, null when it holds no case."""
    return F.array_max(F.transform(context["cases"], lambda c: c["similarity"]))
