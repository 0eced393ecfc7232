"""Queries on sources, validation, velocity, enrichment and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import features as feat
from riskloom.functions import text as tx
from riskloom.operators import enrich, quality, velocity
from riskloom.plans.frames import Frames
from riskloom.plans.oracle import D, R, build
from riskloom.plans.registry import query
from riskloom.sources import messages, tables

FLAT_TXN = ["transactionId", "customerId", "amount", "currency", "merchantId", "merchantCategory", "location",
            "timestamp"]
FLAT_META = ["deviceId", "rapidFire", "sequence", "unusualAmount"]
_TXN_SQL = ", ".join([*FLAT_TXN[:-1], '"timestamp"'])


@query(build(f"SELECT {_TXN_SQL}, {', '.join(FLAT_META)} FROM txn", "txn"))
def transactions(f: Frames) -> DataFrame:
    return f.transactions().select(*FLAT_TXN, *[f"metadata.{m}" for m in FLAT_META])


@query("""
SELECT customerId, averageTransactionAmount, dailySpendingLimit, riskLevel, changedAt, "offset" FROM (
  SELECT 'CUST-' || CAST(o_custkey AS VARCHAR) AS customerId, o_totalprice / 1000 AS averageTransactionAmount,
    o_totalprice / 50 AS dailySpendingLimit,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'HIGH' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS riskLevel,
    o_orderdate AS changedAt, o_orderkey AS "offset",
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_profiles(f: Frames) -> DataFrame:
    """Last value per key of a changelog."""
    return enrich.latest_profiles(tables.profile_changes(f.spark, f.folder))


@query(build("""
SELECT event_id, CASE WHEN k < 3 THEN 'quarantine' ELSE 'valid' END AS status,
  CASE WHEN k = 0 THEN 'malformed' WHEN k = 1 THEN 'currency_missing' WHEN k = 2 THEN 'amount_missing' ELSE '' END AS reasons,
  CASE WHEN k < 3 THEN NULL ELSE 'TXN-' || CAST(event_id AS VARCHAR) END AS transactionId,
  CASE WHEN k < 3 THEN NULL ELSE value END AS amount
FROM ev""", "ev"))
def decoded_messages(f: Frames) -> DataFrame:
    """JSON messages decoded; truncated, incomplete and mistyped ones are set aside with the reason."""
    number, k = F.substring("transactionId", 5, 20).cast("long"), F.col("metadata.sequence")
    whole = F.to_json(F.struct(*FLAT_TXN, "metadata"))
    without = F.to_json(F.struct(*[c for c in FLAT_TXN if c != "currency"], "metadata"))
    mistyped = F.replace(whole, F.lit('"amount":'), F.lit('"amount":"n/a","was":'))
    raw = F.when(k == 0, F.substring(whole, 1, 40)).when(k == 1, without).when(k == 2, mistyped).otherwise(whole)
    sent = f.transactions().select(number.alias("event_id"), raw.alias("value"))
    valid, quarantine = messages.decode_transactions(sent)
    return valid.select("event_id", F.lit("valid").alias("status"), F.lit("").alias("reasons"),
                        "transactionId", "amount").unionByName(
        quarantine.select("event_id", F.lit("quarantine").alias("status"),
                          F.array_join("reasons", ",").alias("reasons"),
                          F.lit(None).cast("string").alias("transactionId"),
                          F.lit(None).cast("double").alias("amount")))


@query(build("""
SELECT transactionId, concat_ws(',', CASE WHEN location = 'Unknown Location' THEN 'location_blank' END,
  CASE WHEN amount - 50 <= 0 THEN 'amount_not_positive' END) AS reasons FROM txn""", "txn"))
def validated_transactions(f: Frames) -> DataFrame:
    """Required text and positive amount; here fees are taken off and unknown places blanked."""
    sent = f.transactions().withColumns({
        "amount": F.col("amount") - 50,
        "location": F.when(F.col("location") == "Unknown Location", " ").otherwise(F.col("location"))})
    valid, rejected = quality.validate_transactions(sent)
    return valid.select("transactionId", F.lit("").alias("reasons")).unionByName(
        rejected.select("transactionId", F.array_join("reasons", ",").alias("reasons")))


@query(build("""
SELECT customerId, time_bucket(INTERVAL '5 minutes', "timestamp") AS windowStart,
  time_bucket(INTERVAL '5 minutes', "timestamp") + INTERVAL '5 minutes' AS windowEnd, count(*) AS velocityCount
FROM txn GROUP BY ALL""", "txn"))
def velocity_windows(f: Frames) -> DataFrame:
    return velocity.velocity_windows(f.transactions())


@query(build("""
SELECT customerId, arg_max(n, w) AS velocityCount, max(w) AS windowStart FROM (
  SELECT customerId, time_bucket(INTERVAL '5 minutes', "timestamp") AS w, count(*) AS n FROM txn GROUP BY ALL)
GROUP BY customerId""", "txn"))
def current_velocity(f: Frames) -> DataFrame:
    return velocity.current_velocity(velocity.velocity_windows(f.transactions()))


@query(build("SELECT transactionId, velocityCount FROM vel5", "vel5"))
def velocity_running(f: Frames) -> DataFrame:
    return velocity.velocity_running(f.transactions()).select("transactionId", "velocityCount")


@query(build("SELECT transactionId, velocityCount FROM vel", "vel"))
def velocity_running_day(f: Frames) -> DataFrame:
    return velocity.velocity_running(f.transactions(), "1 day").select("transactionId", "velocityCount")


@query(build("SELECT transactionId, velocityCount - 1 AS velocityCount FROM vel", "vel"))
def velocity_lagged_day(f: Frames) -> DataFrame:
    return velocity.velocity_lagged(f.transactions(), "1 day").select("transactionId", "velocityCount")


@query("""
SELECT o_orderkey AS orderKey, count(*) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)
  ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS ordersSoFar FROM orders""")
def order_velocity_month(f: Frames) -> DataFrame:
    """The same running count on orders: per customer and calendar month."""
    from riskloom.operators.ordered import running_totals

    orders = f.table("orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    counted = running_totals(orders, ["o_custkey", "month"], ["o_orderdate", "o_orderkey"],
                             {"ordersSoFar": F.lit(1).cast("long")})
    return counted.select(F.col("o_orderkey").alias("orderKey"), "ordersSoFar")


@query(build("SELECT transactionId, customerId, velocityCount FROM vel WHERE velocityCount > 3", "vel"))
def velocity_alerts(f: Frames) -> DataFrame:
    counted = velocity.velocity_running(f.transactions(), "1 day")
    return velocity.velocity_alert(counted).select("transactionId", "customerId", "velocityCount")


@query(build("""
SELECT t.transactionId, t.customerId, p.p_avg AS averageTransactionAmount, p.p_limit AS dailySpendingLimit,
  p.p_risk AS riskLevel, p.p_home AS primaryLocation, array_to_string(p.p_categories, ',') AS categories
FROM txn t LEFT JOIN prof p ON t.customerId = p.p_customerId""", "txn", "prof"))
def profile_join(f: Frames) -> DataFrame:
    joined = enrich.join_profile(f.transactions(), f.profiles())
    return joined.select("transactionId", "customerId", "profile.averageTransactionAmount",
                         "profile.dailySpendingLimit", "profile.riskLevel", "profile.primaryLocation",
                         F.array_join("profile.transactionCategories", ",").alias("categories"))


@query(build("""
SELECT t.transactionId, v.velocityCount FROM txn t LEFT JOIN (
  SELECT customerId, arg_max(n, w) AS velocityCount FROM (
    SELECT customerId, time_bucket(INTERVAL '5 minutes', "timestamp") AS w, count(*) AS n FROM txn GROUP BY ALL)
  GROUP BY customerId) v ON t.customerId = v.customerId""", "txn"))
def velocity_lookup(f: Frames) -> DataFrame:
    txn = f.transactions()
    counts = velocity.current_velocity(velocity.velocity_windows(txn))
    return enrich.join_velocity(txn, counts).select("transactionId", "velocityCount")


@query(build("""
SELECT t.transactionId, s.latestScore FROM txn t LEFT JOIN (
  SELECT customerId, arg_max(mlFraudScore, ("timestamp", transactionId)) AS latestScore FROM sco GROUP BY customerId) s
ON t.customerId = s.customerId""", "sco"))
def latest_score_lookup(f: Frames) -> DataFrame:
    joined = enrich.latest_score_lookup(f.transactions(), f.scored())
    return joined.select("transactionId", "latestScore")


@query(build("""
SELECT transactionId, customerId, velocityCount, p_risk AS riskLevel, p_avg AS average, has_profile AS hasProfile
FROM enr5""", "enr5"), size="5 minutes")
def enriched_record(f: Frames) -> DataFrame:
    """The nested record, opened again after a JSON round trip."""
    from riskloom import schemas

    wire = f.enriched().select(F.to_json(enrich.enriched_record()).alias("value"))
    opened = enrich.from_record(wire.select(F.from_json("value", schemas.ENRICHED).alias("r")).select("r.*"))
    return opened.select("transactionId", "customerId", "velocityCount", "profile.riskLevel",
                         F.col("profile.averageTransactionAmount").alias("average"),
                         feat.has_profile().alias("hasProfile"))


_FEATURE_SQL = ", ".join(S.FEATURES)


@query(build(f"SELECT transactionId, {_FEATURE_SQL} FROM feat", "feat"))
def features_day(f: Frames) -> DataFrame:
    return f.featured().select("transactionId", *S.FEATURES)


@query(build(f"SELECT transactionId, {_FEATURE_SQL} FROM feat5", "feat5"), size="5 minutes")
def features(f: Frames) -> DataFrame:
    return f.featured().select("transactionId", *S.FEATURES)


@query(build(f"""
SELECT transactionId, customerId, amount, currency, merchantId, merchantCategory, location, deviceId, velocityCount,
  is_high_velocity = 1 AS hasHighVelocity, is_amount_unusual = 1 AS isAmountUnusual, risk_a AS customerRiskLevel,
  CASE WHEN has_profile THEN p_avg ELSE {D(0.0)} END AS customerAvgAmount FROM feat""", "feat"))
def flat_enriched(f: Frames) -> DataFrame:
    flat = enrich.flatten_enriched(f.featured())
    return flat.withColumn("deviceId", F.col("metadata.deviceId")).drop("metadata")


MERCHANT_SQL = """CASE WHEN is_suspicious_merchant = 1 AND is_online = 1 THEN 'suspicious online'
  WHEN is_suspicious_merchant = 1 THEN 'suspicious' WHEN is_online = 1 THEN 'online' ELSE 'in-person' END"""
PLACE_SQL = "CASE WHEN is_unknown_location = 1 THEN 'unknown/vpn' ELSE 'known location' END"
TIER_SQL = "CASE WHEN is_high_risk_customer = 1 THEN 'HIGH' WHEN is_low_risk_customer = 1 THEN 'LOW' ELSE 'MEDIUM' END"
DEVICE_SQL = "CASE WHEN is_bot_device = 1 THEN 'bot device detected' ELSE 'normal device' END"


def lines_sql(indent: str) -> str:
    gap = f" || chr(10) || '{indent}' || "
    return gap.join([
        "'velocity: ' || CAST(velocity_count AS VARCHAR) || ' transactions in 5 minutes ' || CASE WHEN is_high_velocity = 1 THEN '(high velocity attack)' ELSE '' END",
        "'amount ratio: ' || printf('%.2f', amount_ratio) || 'x customer baseline ' || CASE WHEN is_amount_unusual = 1 THEN '(unusual amount)' ELSE '' END",
        f"'merchant: ' || {MERCHANT_SQL} || ' ' || CASE WHEN is_typical_category = 1 THEN '' ELSE '(atypical category)' END",
        f"'location: ' || {PLACE_SQL}",
        f"'device: ' || {DEVICE_SQL}",
        "'rapid fire flag: ' || CASE WHEN is_rapid_fire = 1 THEN 'yes' ELSE 'no' END",
        "'transaction hour: ' || CAST(hour AS VARCHAR) || ':00'",
        f"'customer risk tier: ' || {TIER_SQL}",
    ])


@query(build(f"""
SELECT transactionId, {MERCHANT_SQL} AS merchantType, {PLACE_SQL} AS locationStatus, {TIER_SQL} AS riskTier,
  {DEVICE_SQL} AS device FROM feat""", "feat"))
def feature_labels(f: Frames) -> DataFrame:
    return f.featured().select(
        "transactionId", tx.merchant_type().alias("merchantType"), tx.location_status().alias("locationStatus"),
        tx.risk_tier().alias("riskTier"), tx.device_text().alias("device"))


@query(build(f"SELECT transactionId, {lines_sql(tx.QUERY_INDENT)} AS queryText FROM feat", "feat"))
def query_text(f: Frames) -> DataFrame:
    return f.featured().select("transactionId", tx.query_text().alias("queryText"))


BAND_SQL = f"""CASE WHEN mlFraudScore >= {D(0.7)} THEN 'ML strongly indicates fraud.' WHEN mlFraudScore >= {D(0.3)}
  THEN 'ML indicates moderate risk.' ELSE 'ML indicates likely legitimate.' END"""
SCORED_CONTEXT_SQL = f"""concat_ws(chr(10),
  CASE WHEN velocityCount >= 3 THEN 'HIGH VELOCITY: ' || CAST(velocityCount AS VARCHAR) || ' transactions in the last 5 minutes' END,
  CASE WHEN has_profile THEN 'Customer baseline: $' || printf('%.2f', p_avg) || ' avg, ' || p_risk || ' risk.' END,
  'ML MODEL PRE-SCREEN: XGBoost fraud score = ' || CAST({R('mlFraudScore * 100', 1)} AS VARCHAR) || '%. ' || {BAND_SQL})"""


@query(build(f"""
SELECT transactionId, {BAND_SQL} AS band, {SCORED_CONTEXT_SQL} AS scoredContext,
  coalesce(nullif(concat_ws(chr(10),
    CASE WHEN velocityCount >= 3 THEN 'HIGH VELOCITY: ' || CAST(velocityCount AS VARCHAR) || ' transactions in the last 5 minutes' END,
    CASE WHEN has_profile THEN 'Customer baseline: $' || printf('%.2f', p_avg) || ' avg, ' || p_risk || ' risk.' END), ''),
    'No additional streaming context available.') AS bareContext
FROM sco""", "sco"))
def context_text(f: Frames) -> DataFrame:
    score = F.col("mlFraudScore")
    return f.scored().select(
        "transactionId", tx.ml_band(score).alias("band"), tx.context_text(score).alias("scoredContext"),
        tx.context_text().alias("bareContext"))
