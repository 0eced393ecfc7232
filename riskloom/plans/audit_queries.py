"""Queries on the audit tables: views, lookups, updates, integrity and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import analytics, audit, quality, stats
from riskloom.plans import decision_queries  # noqa: F401 - the audit answers build on its expressions
from riskloom.plans.frames import Frames
from riskloom.plans.oracle import D, build
from riskloom.plans.registry import query


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in columns})


def _tally(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


@query(build(f"""
SELECT fraud_pattern, count(*) AS total_cases, round(avg(CAST(ml_score AS DOUBLE)), 4) AS avg_ml_score,
  round(avg(CAST(llm_confidence AS DOUBLE)), 4) AS avg_llm_confidence, {_tally("decision = 'BLOCK'")} AS blocked_count,
  {_tally("decision = 'REVIEW'")} AS review_count, {_tally("rag_context_used")} AS rag_assisted_count,
  min(decided_at) AS first_seen, max(decided_at) AS last_seen
FROM a_dec WHERE fraud_pattern IS NOT NULL GROUP BY fraud_pattern""", "a_dec"))
def fraud_summary_by_pattern(f: Frames) -> DataFrame:
    return _rounded(analytics.fraud_summary_by_pattern(f.audit_decisions()), "avg_ml_score", "avg_llm_confidence")


@query(build(f"""
SELECT analyst_id, count(*) AS total_reviews, round(avg(time_to_review_seconds), 4) AS avg_review_time_sec,
  {_tally("review_outcome = 'CONFIRMED_FRAUD'")} AS confirmed_fraud, {_tally("review_outcome = 'FALSE_POSITIVE'")} AS false_positives,
  {_tally("review_outcome = 'ESCALATED'")} AS escalated, min(reviewed_at) AS first_review, max(reviewed_at) AS last_review
FROM a_rev WHERE analyst_id IS NOT NULL GROUP BY analyst_id""", "a_rev"))
def analyst_performance(f: Frames) -> DataFrame:
    return _rounded(analytics.analyst_performance(f.audit_reviews()), "avg_review_time_sec")


_TRUTH_SQL = f"""SELECT p.id, p.transaction_id, p.model_type, p.prediction_score, p.prediction_time_ms, p.predicted_at,
  l.actualFraud AS actual_label, (p.prediction_score >= 0.5) = l.actualFraud AS prediction_correct,
  CASE WHEN l.labelledId IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
FROM a_pred p LEFT JOIN lab l ON p.transaction_id = l.labelledId"""


def _labelled(f: Frames) -> DataFrame:
    return audit.apply_ground_truth(f.audit_predictions(), f.audit_labels())


@query(build(f"SELECT * FROM ({_TRUTH_SQL})", "a_pred", "lab"))
def ground_truth(f: Frames) -> DataFrame:
    return _labelled(f).select("id", "transaction_id", "model_type", "prediction_score", "prediction_time_ms", "predicted_at",
                               "actual_label", "prediction_correct", "updated_at")


@query(build(f"""
SELECT model_type, count(*) AS total_predictions, round(avg(CAST(prediction_score AS DOUBLE)), 4) AS avg_score,
  round(avg(prediction_time_ms), 4) AS avg_latency_ms,
  round(CAST({_tally("prediction_correct")} AS DOUBLE) / nullif({_tally("prediction_correct IS NOT NULL")}, 0), 4) AS accuracy,
  min(predicted_at) AS first_prediction, max(predicted_at) AS last_prediction
FROM ({_TRUTH_SQL}) GROUP BY model_type""", "a_pred", "lab"))
def model_performance(f: Frames) -> DataFrame:
    return _rounded(analytics.model_performance(_labelled(f)), "avg_score", "avg_latency_ms", "accuracy")


@query(build("""
SELECT (SELECT count(*) FROM a_txn) AS total_transactions, (SELECT count(*) FROM a_dec) AS total_fraud_decisions,
  (SELECT count(*) FROM a_rev) AS total_case_reviews""", "a_txn", "a_dec", "a_rev"))
def summary_counts(f: Frames) -> DataFrame:
    return analytics.summary_counts(transactions=f.audit_transactions(), fraud_decisions=f.audit_decisions(),
                                    case_reviews=f.audit_reviews())


@query(build('SELECT decision, count(*) AS "count" FROM a_dec WHERE decision IS NOT NULL GROUP BY decision', "a_dec"))
def decision_distribution(f: Frames) -> DataFrame:
    return analytics.decision_distribution(f.audit_decisions())


@query(build("""
SELECT fraud_pattern AS pattern, count(*) AS "count" FROM a_dec WHERE fraud_pattern IS NOT NULL GROUP BY fraud_pattern
ORDER BY "count" DESC, pattern LIMIT 10""", "a_dec"))
def top_patterns(f: Frames) -> DataFrame:
    return analytics.top_patterns(f.audit_decisions())


# --- lookups ----------------------------------------------------------------

@query(build("""
SELECT transaction_id, customer_id, amount, merchant_id, merchant_category, location, device_id, "timestamp", velocity_5min,
  avg_transaction_amount FROM a_txn""", "a_txn"))
def audit_transactions(f: Frames) -> DataFrame:
    return f.audit_transactions().drop("created_at", "account_age_days")


@query(build("""
SELECT id, transaction_id, ml_score, shap_top_features, llm_confidence, fraud_pattern, reasoning, recommendation, rag_context_used,
  rag_similarity_score, rag_cases_retrieved, decision, decided_at FROM a_dec""", "a_dec"))
def audit_decisions(f: Frames) -> DataFrame:
    shown = F.array_join(F.transform("shap_top_features", lambda t: F.concat(t["feature"], F.lit(":"), tx.fixed(t["value"], 6))), ",")
    return f.audit_decisions().drop("ml_model_type").withColumn("shap_top_features", shown)


@query(build("""
SELECT id, transaction_id, ml_score, llm_confidence, fraud_pattern, decision, reasoning, rag_context_used, decided_at
FROM a_dec ORDER BY decided_at DESC, id DESC LIMIT 100""", "a_dec"))
def recent_decisions(f: Frames) -> DataFrame:
    return audit.recent_decisions(f.audit_decisions())


@query(build("""
SELECT id, transaction_id, ml_score, llm_confidence, fraud_pattern, decision, reasoning, rag_context_used, decided_at
FROM a_dec WHERE fraud_pattern = 'card_testing' ORDER BY decided_at DESC, id DESC LIMIT 100""", "a_dec"))
def recent_decisions_by_pattern(f: Frames) -> DataFrame:
    return audit.recent_decisions(f.audit_decisions(), pattern="card_testing")


@query(build("""
SELECT customer_id, transaction_id, amount, "timestamp", CAST("position" AS INTEGER) AS "position" FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC, transaction_id DESC) AS "position" FROM a_txn)
WHERE "position" <= 100""", "a_txn"))
def customer_transactions(f: Frames) -> DataFrame:
    """The newest hundred transactions of every customer."""
    rows = audit.customer_transactions(f.audit_transactions(), limit=100)
    return rows.select("customer_id", "transaction_id", "amount", "timestamp", "position")


@query(build("""
SELECT * FROM (
  SELECT t.transaction_id, t.customer_id, t.amount, t.merchant_id, t.merchant_category, t."timestamp", d.decision,
    d.fraud_pattern, d.llm_confidence, d.ml_score,
    CAST(row_number() OVER (PARTITION BY t.customer_id ORDER BY t."timestamp" DESC, t.transaction_id DESC, d.id) AS INTEGER) AS "position"
  FROM a_txn t LEFT JOIN a_dec d ON t.transaction_id = d.transaction_id) WHERE "position" <= 50""", "a_txn", "a_dec"))
def transaction_history(f: Frames) -> DataFrame:
    """The newest fifty of every customer, with decisions."""
    return audit.transaction_history(f.audit_transactions(), f.audit_decisions())


# --- keyed updates and integrity ----------------------------------------------

def _customers(f: Frames) -> DataFrame:
    """The stored snapshot, from ``customer``: balance stands in for the risk score."""
    key = F.col("c_custkey")
    return f.table("customer").select(
        F.concat(F.lit("CUST-"), key.cast("string")).alias("customer_id"),
        (F.col("c_acctbal") / 25).cast("decimal(12,2)").alias("avg_transaction_amount"),
        F.lower("c_mktsegment").alias("typical_merchant_category"),
        (key % 1000).cast("int").alias("account_age_days"),
        (F.col("c_acctbal") / 125).cast("decimal(5,2)").alias("risk_score"),
        (key % 50).cast("int").alias("total_transactions"),
        (key % 7).cast("int").alias("total_fraud_cases"),
        F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("last_transaction_at"),
        F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("last_updated"),
        F.lit(1).alias("version"),
    )


def _updates(f: Frames) -> DataFrame:
    """Per customer totals of the new transactions; suppliers arrive as new customers without totals."""
    spent = f.transactions().groupBy(F.col("customerId").alias("customer_id")).agg(
        F.max("amount").cast("decimal(12,2)").alias("avg_transaction_amount"),
        F.max("merchantCategory").alias("typical_merchant_category"),
        F.lit(None).cast("int").alias("account_age_days"),
        F.lit(25).cast("decimal(5,2)").alias("risk_score"),
        F.count(F.lit(1)).cast("int").alias("total_transactions"),
        F.lit(None).cast("int").alias("total_fraud_cases"),
        F.max("timestamp").alias("last_transaction_at"))
    new = f.table("supplier").select(
        F.concat(F.lit("NEW-"), F.col("s_suppkey").cast("string")).alias("customer_id"),
        F.lit(None).cast("decimal(12,2)").alias("avg_transaction_amount"),
        F.lit("wholesale").alias("typical_merchant_category"), F.lit(1).alias("account_age_days"),
        F.lit(None).cast("decimal(5,2)").alias("risk_score"), F.lit(None).cast("int").alias("total_transactions"),
        F.lit(None).cast("int").alias("total_fraud_cases"), F.lit(None).cast("timestamp_ntz").alias("last_transaction_at"))
    return spent.unionByName(new)


_CUSTOMER_SQL = f"""SELECT 'CUST-' || CAST(c_custkey AS VARCHAR) AS customer_id,
  CAST(round(c_acctbal / 25, 2) AS DECIMAL(12,2)) AS avg_transaction_amount, lower(c_mktsegment) AS typical_merchant_category,
  CAST(c_custkey % 1000 AS INTEGER) AS account_age_days, CAST(round(c_acctbal / 125, 2) AS DECIMAL(5,2)) AS risk_score,
  CAST(c_custkey % 50 AS INTEGER) AS total_transactions, CAST(c_custkey % 7 AS INTEGER) AS total_fraud_cases,
  TIMESTAMP '2023-12-31 00:00:00' AS last_transaction_at, TIMESTAMP '2023-12-31 00:00:00' AS last_updated, 1 AS version FROM customer"""


@query(build(f"""
SELECT customer_id, CAST(CASE WHEN n_id IS NOT NULL THEN coalesce(n_avg, 0) ELSE avg_transaction_amount END AS DECIMAL(12,2)) AS avg_transaction_amount,
  CAST(CASE WHEN n_id IS NULL THEN risk_score WHEN n_id LIKE 'NEW-%' THEN 0 ELSE 25 END AS DECIMAL(5,2)) AS risk_score,
  CASE WHEN n_id IS NOT NULL THEN n_cat ELSE typical_merchant_category END AS typical_merchant_category,
  CASE WHEN n_id IS NOT NULL THEN n_age ELSE account_age_days END AS account_age_days,
  coalesce(n_total, total_transactions, 0) AS total_transactions, coalesce(total_fraud_cases, 0) AS total_fraud_cases,
  CASE WHEN n_id IS NOT NULL THEN n_last ELSE last_transaction_at END AS last_transaction_at,
  CASE WHEN n_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_updated END AS last_updated,
  CAST(CASE WHEN n_id IS NOT NULL AND version IS NOT NULL THEN version + 1 WHEN n_id IS NOT NULL THEN 1 ELSE version END AS INTEGER) AS version
FROM (SELECT coalesce(c.customer_id, n.n_id) AS customer_id, c.* EXCLUDE (customer_id), n.* FROM ({_CUSTOMER_SQL}) c
  FULL OUTER JOIN (
    SELECT customerId AS n_id, CAST(max(amount) AS DECIMAL(12,2)) AS n_avg, max(merchantCategory) AS n_cat, CAST(NULL AS INTEGER) AS n_age,
      CAST(count(*) AS INTEGER) AS n_total, max("timestamp") AS n_last FROM txn GROUP BY customerId
    UNION ALL SELECT 'NEW-' || CAST(s_suppkey AS VARCHAR), NULL, 'wholesale', 1, NULL, NULL FROM supplier) n
  ON c.customer_id = n.n_id)""", "txn"))
def upserted_customers(f: Frames) -> DataFrame:
    moment = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return audit.upsert_customers(_customers(f), _updates(f), moment)


@query(build("""
SELECT 'decision without transaction' AS relation, (SELECT count(*) FROM a_dec d WHERE NOT EXISTS (SELECT 1 FROM a_txn t WHERE t.transaction_id = d.transaction_id)) AS orphans
UNION ALL SELECT 'review without decision', (SELECT count(*) FROM a_rev r WHERE NOT EXISTS (SELECT 1 FROM a_dec d WHERE d.transaction_id = r.transaction_id))
UNION ALL SELECT 'review without transaction', (SELECT count(*) FROM a_rev r WHERE NOT EXISTS (SELECT 1 FROM a_txn t WHERE t.transaction_id = r.transaction_id))
UNION ALL SELECT 'customer without transaction', (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM a_txn t WHERE t.customer_id = 'CUST-' || CAST(c_custkey AS VARCHAR)))
UNION ALL SELECT 'prediction without review', (SELECT count(*) FROM a_pred p WHERE NOT EXISTS (SELECT 1 FROM a_rev r WHERE r.transaction_id = p.transaction_id AND r.analyst_id <> 'system'))""",
    "a_dec", "a_txn", "a_rev", "a_pred"))
def orphan_report(f: Frames) -> DataFrame:
    transactions, decisions, reviews = f.audit_transactions(), f.audit_decisions(), f.audit_reviews()
    found = {
        "decision without transaction": audit.orphans(decisions, transactions, "transaction_id"),
        "review without decision": audit.orphans(reviews, decisions, "transaction_id"),
        "review without transaction": audit.orphans(reviews, transactions, "transaction_id"),
        "customer without transaction": audit.orphans(_customers(f), transactions, "customer_id"),
        "prediction without review": audit.orphans(
            f.audit_predictions(), reviews.where(F.col("analyst_id") != "system"), "transaction_id"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(n).alias("relation"), "orphans") for n, df in found.items()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


# --- quality ------------------------------------------------------------------

def _violations_sql(table: str, source: str, rules: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, (SELECT count(*) FROM {source} WHERE {broken}) AS violations, "
        f"(SELECT count(*) FROM {source}) AS checked" for rule, broken in rules)


@query(build(" UNION ALL ".join([
    _violations_sql("transactions", "a_txn", [
        ("transaction_id_missing", "transaction_id IS NULL"), ("customer_id_missing", "customer_id IS NULL"),
        ("amount_missing", "amount IS NULL"), ("amount_negative", "amount < 0"), ("timestamp_missing", '"timestamp" IS NULL'),
        ("timestamp_in_future", '"timestamp" > TIMESTAMP \'2026-01-01\'')]),
    _violations_sql("customers", "cust", [
        ("customer_id_missing", "customer_id IS NULL"), ("account_age_negative", "account_age_days < 0"),
        ("risk_score_range", "risk_score < 0 OR risk_score > 100"), ("fraud_above_total", "total_fraud_cases > total_transactions")]),
    _violations_sql("fraud_decisions", "a_dec", [
        ("transaction_id_missing", "transaction_id IS NULL"), ("ml_score_range", "ml_score < 0 OR ml_score > 1"),
        ("confidence_range", "llm_confidence < 0 OR llm_confidence > 100"),
        ("similarity_without_context", "rag_similarity_score IS NOT NULL AND NOT rag_context_used"),
        ("decision_value", "decision NOT IN ('BLOCK', 'REVIEW', 'APPROVE')")]),
    _violations_sql("case_reviews", "a_rev", [
        ("transaction_id_missing", "transaction_id IS NULL"),
        ("outcome_value", "review_outcome NOT IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE', 'ESCALATED', 'LEGITIMATE')"),
        ("review_time_negative", "time_to_review_seconds < 0"), ("level_value", "confidence_level NOT IN ('LOW', 'MEDIUM', 'HIGH')")]),
    _violations_sql("model_predictions", "a_pred", [
        ("transaction_id_missing", "transaction_id IS NULL"),
        ("model_value", "model_type NOT IN ('xgboost', 'river_srp', 'llm_ensemble')"),
        ("score_range", "prediction_score < 0 OR prediction_score > 1"), ("prediction_time_negative", "prediction_time_ms < 0")]),
]), "a_txn", "a_dec", "a_rev", "a_pred").replace("\nSELECT 'transactions' AS table_name", f",\ncust AS ({_CUSTOMER_SQL})\nSELECT 'transactions' AS table_name", 1))
def audit_violations(f: Frames) -> DataFrame:
    return quality.audit_violations({
        "transactions": f.audit_transactions(), "customers": _customers(f), "fraud_decisions": f.audit_decisions(),
        "case_reviews": f.audit_reviews(), "model_predictions": f.audit_predictions()},
        "timestamp_ntz'2026-01-01 00:00:00'")


@query(f"SELECT customer_id, concat_ws(',', CASE WHEN risk_score < 0 OR risk_score > 100 THEN 'risk_score_range' END, "
       f"CASE WHEN total_fraud_cases > total_transactions THEN 'fraud_above_total' END) AS reasons FROM ({_CUSTOMER_SQL}) "
       "WHERE risk_score < 0 OR risk_score > 100 OR total_fraud_cases > total_transactions")
def quarantined_customers(f: Frames) -> DataFrame:
    _, failing = quality.quarantine(_customers(f), quality.RULES["customers"])
    return failing.select("customer_id", F.array_join("reasons", ",").alias("reasons"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(f: Frames) -> DataFrame:
    """Keys that should be unique and are not."""
    return quality.duplicate_keys(f.table("lineitem"), ["l_orderkey", "l_linenumber"])


_STAT_FEATURES = ["amount_ratio", "velocity_count", "is_bot_device"]


@query(build("""
SELECT 'transactions' AS table_name, count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM a_txn GROUP BY transaction_id)
UNION ALL SELECT 'customers', count(*) FILTER (n > 1), CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)
UNION ALL SELECT 'fraud_decisions', count(*) FILTER (n > 1), CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM a_dec GROUP BY id)
UNION ALL SELECT 'case_reviews', count(*) FILTER (n > 1), CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM a_rev GROUP BY id)
UNION ALL SELECT 'model_predictions', count(*) FILTER (n > 1), CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM a_pred GROUP BY id)""",
    "a_txn", "a_dec", "a_rev", "a_pred"))
def uniqueness_report(f: Frames) -> DataFrame:
    return quality.uniqueness_report({
        "transactions": f.audit_transactions(), "customers": _customers(f), "fraud_decisions": f.audit_decisions(),
        "case_reviews": f.audit_reviews(), "model_predictions": f.audit_predictions()})


@query(build(" UNION ALL ".join(
    f"SELECT '{rule}' AS rule, CAST(0 AS BIGINT) AS violations, (SELECT count(*) FROM days) * {len(_STAT_FEATURES) * 11} AS checked"
    for rule in ("feature_missing", "stat_value_type", "window_order")), "feat").replace(
    "\nSELECT 'feature_missing'", """,
days AS (SELECT DISTINCT date_trunc('day', "timestamp") AS d FROM feat)
SELECT 'feature_missing'""", 1))
def feature_stat_checks(f: Frames) -> DataFrame:
    """Audit rows of three features' daily statistics keep the table's rules."""
    rows = audit.feature_stat_rows(stats.feature_stats(f.featured(), _STAT_FEATURES))
    return quality.violation_counts(rows, quality.RULES["feature_stats"])


@query(build(" UNION ALL ".join(
    f"SELECT '{name}' AS feature_name, round(avg(CASE WHEN {column} IS NULL THEN {D(1.0)} ELSE {D(0.0)} END), 6) AS null_rate, count(*) AS sample_count FROM sq"
    for name, column in [("profile", "p_customerId"), ("profile_averageTransactionAmount", "p_avg"), ("actualFraud", "actualFraud"),
                         ("velocityCount", "velocityCount")])
    , "enr", "lab").replace("\nSELECT 'profile'", ",\nsq AS (SELECT * FROM enr LEFT JOIN lab ON enr.transactionId = lab.labelledId)\nSELECT 'profile'", 1))
def null_rates(f: Frames) -> DataFrame:
    labels, enriched = f.labels(), f.enriched()
    joined = enriched.join(labels, enriched["transactionId"] == labels["labelledId"], "left")
    rates = quality.null_rates(joined, ["profile", "profile.averageTransactionAmount", "actualFraud", "velocityCount"])
    return rates.withColumn("null_rate", F.round("null_rate", 6))
