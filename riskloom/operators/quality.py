"""Data-quality checks derived from the audit constraints."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named SQL predicate that is true for a row breaking the rule."""

    name: str
    broken: str

    def column(self) -> Column:
        return F.coalesce(F.expr(self.broken), F.lit(False))


def _outside(column: str, low: float, high: float) -> str:
    return f"{column} < {low} OR {column} > {high}"


def _not_in(column: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"{column} NOT IN ({listed})"


# The constraints of each audit table.
RULES = {
    "transactions": [
        Rule("transaction_id_missing", "transaction_id IS NULL"),
        Rule("customer_id_missing", "customer_id IS NULL"),
        Rule("amount_missing", "amount IS NULL"),
        Rule("amount_negative", "amount < 0"),
        Rule("timestamp_missing", "timestamp IS NULL"),
        Rule("timestamp_in_future", "timestamp > localtimestamp()"),
    ],
    "customers": [
        Rule("customer_id_missing", "customer_id IS NULL"),
        Rule("account_age_negative", "account_age_days < 0"),
        Rule("risk_score_range", _outside("risk_score", 0, 100)),
        Rule("fraud_above_total", "total_fraud_cases > total_transactions"),
    ],
    "fraud_decisions": [
        Rule("transaction_id_missing", "transaction_id IS NULL"),
        Rule("ml_score_range", _outside("ml_score", 0, 1)),
        Rule("confidence_range", _outside("llm_confidence", 0, 100)),
        Rule("similarity_without_context", "rag_similarity_score IS NOT NULL AND NOT rag_context_used"),
        Rule("decision_value", _not_in("decision", "BLOCK", "REVIEW", "APPROVE")),
    ],
    "case_reviews": [
        Rule("transaction_id_missing", "transaction_id IS NULL"),
        Rule("outcome_value", _not_in("review_outcome", "CONFIRMED_FRAUD", "FALSE_POSITIVE", "ESCALATED",
                                      "LEGITIMATE")),
        Rule("review_time_negative", "time_to_review_seconds < 0"),
        Rule("level_value", _not_in("confidence_level", "LOW", "MEDIUM", "HIGH")),
    ],
    "model_predictions": [
        Rule("transaction_id_missing", "transaction_id IS NULL"),
        Rule("model_value", _not_in("model_type", "xgboost", "river_srp", "llm_ensemble")),
        Rule("score_range", _outside("prediction_score", 0, 1)),
        Rule("prediction_time_negative", "prediction_time_ms < 0"),
    ],
    "feature_stats": [
        Rule("feature_missing", "feature_name IS NULL"),
        Rule("stat_value_type", _not_in("stat_type", "mean", "stddev", "median", "p25", "p50", "p75", "p95",
                                        "p99", "min", "max", "null_rate")),
        Rule("window_order", "window_end <= window_start"),
    ],
}
NOW = "localtimestamp()"


def rules_at(table: str, moment: str = NOW) -> list[Rule]:
    """The table's rules as of a moment (a SQL expression); replayed data is judged by its own time."""
    return [replace(rule, broken=rule.broken.replace(NOW, moment)) for rule in RULES[table]]


UNIQUE_KEYS = {
    "transactions": ["transaction_id"], "customers": ["customer_id"], "fraud_decisions": ["id"],
    "case_reviews": ["id"], "model_predictions": ["id"],
    "feature_stats": ["feature_name", "stat_type", "window_start"],
}


def violation_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, violations, checked), all rules in one pass over the rows."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.coalesce(F.sum(r.column().cast("long")), F.lit(0)).alias(r.name) for r in rules],
    )
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("violations")) for r in rules])
    return counted.select(F.inline(pairs), F.col("_rows").alias("checked"))


def audit_violations(tables: dict[str, DataFrame], moment: str = NOW) -> DataFrame:
    parts = [
        violation_counts(df, rules_at(name, moment)).select(F.lit(name).alias("table_name"), "rule", "violations", "checked")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def broken_rules(rules: list[Rule]) -> Column:
    """Names of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(r.column(), F.lit(r.name)) for r in rules]))


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(passing rows, failing rows with their ``reasons``)."""
    marked = df.withColumn("reasons", broken_rules(rules))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def uniqueness_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, duplicate_keys, extra_rows) over each table's unique key."""
    parts = []
    for name, df in tables.items():
        copies = duplicate_keys(df, UNIQUE_KEYS[name])
        parts.append(copies.agg(
            F.count(F.lit(1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_rows"),
        ).select(F.lit(name).alias("table_name"), "duplicate_keys", "extra_rows"))
    return reduce(DataFrame.unionByName, parts)


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_name, null_rate, sample_count), one pass, no unpivot of the rows."""
    rates = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(c.replace(".", "_")) for c in columns],
    )
    pairs = F.array(*[
        F.struct(F.lit(c.replace(".", "_")).alias("feature_name"), F.col(c.replace(".", "_")).alias("null_rate"))
        for c in columns
    ])
    return rates.select(F.inline(pairs), F.col("_rows").alias("sample_count"))


# The text fields a transaction must fill.
REQUIRED_TEXT = ["transactionId", "customerId", "currency", "merchantId", "merchantCategory", "location"]


def transaction_rules() -> list[Rule]:
    blank = [Rule(f"{c}_blank", f"{c} IS NULL OR {c} RLIKE '^\\\\s*$'") for c in REQUIRED_TEXT]
    return [*blank, Rule("amount_missing", "amount IS NULL"), Rule("amount_not_positive", "amount <= 0")]


def validate_transactions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons): required text filled and amount above zero."""
    return quarantine(df, transaction_rules())
