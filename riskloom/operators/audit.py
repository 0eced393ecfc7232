"""Audit rows, keyed updates, and integrity between audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom import settings as S
from riskloom.functions import features as feat
from riskloom.operators import routing
from riskloom.operators.panel import recommendation


def transaction_rows(featured: DataFrame) -> DataFrame:
    return featured.select(
        F.col("transactionId").alias("transaction_id"), F.col("customerId").alias("customer_id"),
        F.col("amount").cast("decimal(12,2)").alias("amount"), F.col("merchantId").alias("merchant_id"),
        F.col("merchantCategory").alias("merchant_category"), "location",
        F.col("metadata.deviceId").alias("device_id"), "timestamp",
        F.col("timestamp").alias("created_at"),
        F.coalesce("velocityCount", F.lit(0)).cast("int").alias("velocity_5min"),
        F.when(feat.has_profile(), F.col("profile.averageTransactionAmount")).cast("decimal(12,2)")
        .alias("avg_transaction_amount"),
        F.lit(None).cast("int").alias("account_age_days"),
    )


def prediction_rows(scored: DataFrame, row_id: Column | None = None, model: str = "xgboost") -> DataFrame:
    """Expects mlFraudScore, topFeatures, latencyMs, modelVersion and timestamp."""
    return scored.select(
        (F.xxhash64("transactionId") if row_id is None else row_id).alias("id"),
        F.col("transactionId").alias("transaction_id"), F.lit(model).alias("model_type"),
        F.col("mlFraudScore").cast("decimal(5,4)").alias("prediction_score"),
        F.col("topFeatures").alias("top_features"),
        F.col("latencyMs").cast("int").alias("prediction_time_ms"), F.col("timestamp").alias("predicted_at"),
        F.col("modelVersion").alias("model_version"), F.lit(None).cast("boolean").alias("actual_label"),
        F.lit(None).cast("boolean").alias("prediction_correct"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def decision_rows(decided: DataFrame, row_id: Column | None = None, legacy: bool = False) -> DataFrame:
    """Expects mlFraudScore, topFeatures, casesFound, maxSimilarity, reasoning and the decision columns."""
    confidence = F.col("confidenceScore")
    used = F.coalesce(F.col("casesFound") > 0, F.lit(False))
    return decided.select(
        (F.xxhash64("transactionId") if row_id is None else row_id).alias("id"),
        F.col("transactionId").alias("transaction_id"),
        F.col("mlFraudScore").cast("decimal(5,4)").alias("ml_score"),
        F.lit("xgboost").alias("ml_model_type"), F.col("topFeatures").alias("shap_top_features"),
        confidence.cast("decimal(5,2)").alias("llm_confidence"),
        F.col("fraudPattern").alias("fraud_pattern"), F.col("reasoning"),
        recommendation(confidence).alias("recommendation"),
        used.alias("rag_context_used"),
        F.when(used, F.col("maxSimilarity")).cast("decimal(5,4)").alias("rag_similarity_score"),
        F.coalesce("casesFound", F.lit(0)).cast("int").alias("rag_cases_retrieved"),
        routing.audit_decision(confidence, legacy).alias("decision"),
        F.col("timestamp").alias("decided_at"),
    )


def feature_stat_rows(stats: DataFrame, now: Column | None = None) -> DataFrame:
    """Computed feature statistics as audit rows."""
    key = F.xxhash64("feature_name", "stat_type", "window_start")
    return stats.select(
        key.alias("id"), "feature_name", "stat_type", F.round("stat_value", 4).cast("decimal(12,4)").alias("stat_value"),
        F.col("sample_count").cast("int").alias("sample_count"), "window_start", "window_end",
        (F.current_timestamp().cast("timestamp_ntz") if now is None else now).alias("computed_at"))


# --- lookups --------------------------------------------------------------

def customer_transactions(transactions: DataFrame, customer: str | None = None, limit: int = 100) -> DataFrame:
    """Newest transactions of one customer, or of every customer.

    The ranked form prunes to ``limit`` rows per customer before the shuffle,
    so a hot customer never reaches one task whole.
    """
    if customer is not None:
        mine = transactions.where(F.col("customer_id") == customer)
        return mine.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(limit)
    newest = Window.partitionBy("customer_id").orderBy(F.desc("timestamp"), F.desc("transaction_id"))
    return transactions.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)


def transaction_history(transactions: DataFrame, decisions: DataFrame, customer: str | None = None,
                        limit: int = 50) -> DataFrame:
    """Transactions with their decisions, newest first; one row per decision.

    The bulk form cuts each customer to ``limit`` transactions before joining,
    because the join can only add rows after that cut, and then ranks again.
    """
    shown = decisions.select("transaction_id", "decision", "fraud_pattern", "llm_confidence", "ml_score",
                             F.col("id").alias("decision_id"))
    wanted = customer_transactions(
        transactions.select("transaction_id", "customer_id", "amount", "merchant_id", "merchant_category",
                            "timestamp"), customer, limit)
    joined = wanted.drop("position").join(shown, "transaction_id", "left")
    order = [F.desc("timestamp"), F.desc("transaction_id"), F.asc("decision_id")]
    if customer is not None:
        return joined.orderBy(*order).limit(limit).drop("decision_id")
    newest = Window.partitionBy("customer_id").orderBy(*order)
    return joined.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)\
        .drop("decision_id")


def recent_decisions(decisions: DataFrame, limit: int = 100, pattern: str | None = None) -> DataFrame:
    """Newest decisions first, optionally of one pattern (limit 1 to 1000)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    rows = decisions if pattern is None else decisions.where(F.col("fraud_pattern") == pattern)
    return rows.select(
        "id", "transaction_id", "ml_score", "llm_confidence", "fraud_pattern", "decision", "reasoning",
        "rag_context_used", "decided_at",
    ).orderBy(F.desc("decided_at"), F.desc("id")).limit(limit)


# --- keyed updates --------------------------------------------------------

def upsert_customers(current: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """New snapshot: insert or overwrite by id, version + 1; absent totals keep the old value."""
    moment = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    old, new = F.col("o"), F.col("n")
    joined = current.select("customer_id", F.struct(*current.columns).alias("o")).join(
        updates.select("customer_id", F.struct(*updates.columns).alias("n")), "customer_id", "full_outer")
    given, known = new.isNotNull(), old.isNotNull()

    def overwritten(field: str) -> Column:
        return F.when(given, new[field]).otherwise(old[field]).alias(field)

    def amount(field: str, kind: str) -> Column:
        return F.when(given, F.coalesce(new[field], F.lit(0)).cast(kind)).otherwise(old[field]).cast(kind).alias(field)

    def total(field: str) -> Column:
        return F.coalesce(new[field], old[field], F.lit(0)).cast("int").alias(field)

    return joined.select(
        "customer_id",
        amount("avg_transaction_amount", "decimal(12,2)"),
        overwritten("typical_merchant_category"),
        overwritten("account_age_days"),
        amount("risk_score", "decimal(5,2)"),
        total("total_transactions"),
        total("total_fraud_cases"),
        overwritten("last_transaction_at"),
        F.when(given, moment).otherwise(old["last_updated"]).alias("last_updated"),
        F.when(given & known, old["version"] + 1).when(given, F.lit(1)).otherwise(old["version"])
        .cast("int").alias("version"),
    )


def apply_ground_truth(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Set label, correctness and time on the first row per (transaction, model).

    ``labels`` has transaction_id, model_type, actual_label, updated_at, one
    row per key. The first row is found with a partial ``min``, not a window,
    so a key with many rows is reduced before it is shuffled.
    """
    keys = ["transaction_id", "model_type"]
    first = predictions.groupBy(*keys).agg(F.min("id").alias("id"))
    truth = first.join(
        labels.select(*keys, F.col("actual_label").alias("_actual"), F.col("updated_at").alias("_at")), keys,
    ).select("id", *keys, "_actual", "_at")
    hit = F.col("_actual").isNotNull()
    right = (F.col("prediction_score") >= 0.5) == F.col("_actual")
    return predictions.join(truth, ["id", *keys], "left").withColumns({
        "actual_label": F.coalesce("_actual", "actual_label"),
        "prediction_correct": F.when(hit, right).otherwise(F.col("prediction_correct")),
        "updated_at": F.when(hit, F.col("_at")).otherwise(F.col("updated_at")),
    }).select(*predictions.columns)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null key has no parent row."""
    parents = parent.select(F.col(parent_key or key).alias("_parent"))
    return child.where(F.col(key).isNotNull()).join(parents, F.col(key) == F.col("_parent"), "left_anti")
