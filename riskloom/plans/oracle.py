"""Reference answers: one DuckDB statement per registered query.

The statements are written from the raw tables, independently of the
DataFrame code. Shared steps are common table expressions; each statement
lists only the ones it needs.
"""

from __future__ import annotations

from riskloom import settings as S
from riskloom.functions import prompts as P
from riskloom.functions import text as tx
from riskloom.operators import panel


def D(value: float) -> str:
    """A DOUBLE literal (DuckDB reads a bare decimal as DECIMAL)."""
    return f"CAST({value!r} AS DOUBLE)"


def R(value: str, digits: int) -> str:
    """Rounded on the exact binary value, ties to even."""
    return f"CAST(printf('%.{digits}f', {value}) AS DOUBLE)"


def q(text: str) -> str:
    """A string literal, newlines spelt out."""
    parts = text.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"


FLAG = "CAST(CASE WHEN {0} THEN 1 ELSE 0 END AS INTEGER)"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def build(body: str, *needs: str) -> str:
    """``WITH`` the needed expressions in dependency order, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for need in needs:
        add(need)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


# --- domain mapping -------------------------------------------------------

cte("ev", [], "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")

cte("txn", ["ev"], """
SELECT 'TXN-' || CAST(event_id AS VARCHAR) AS transactionId, 'CUST-' || CAST(user_id AS VARCHAR) AS customerId,
  value AS amount, 'USD' AS currency,
  CASE WHEN event_type = 'error' OR k % 9 = 0 THEN 'MERCHANT-SUSPICIOUS-' || CAST(event_id % 10 AS VARCHAR)
       ELSE 'MERCHANT-' || CAST(event_id % 1000 AS VARCHAR) END AS merchantId,
  CASE event_type WHEN 'purchase' THEN 'ONLINE' WHEN 'view' THEN 'GROCERY' WHEN 'click' THEN 'RETAIL'
       WHEN 'signup' THEN 'RESTAURANT' ELSE CASE WHEN k < 80 THEN 'ONLINE' ELSE 'LUXURY_GOODS' END END
    AS merchantCategory,
  CASE WHEN (event_type = 'error' AND k < 60) OR k % 10 = 3 THEN 'Unknown Location'
       WHEN k % 4 = 1 THEN 'Different Location' ELSE 'NATION_' || CAST(user_id % 25 AS VARCHAR) END AS location,
  ts AS "timestamp",
  (CASE WHEN k < 10 OR (event_type = 'error' AND k % 3 <> 0) THEN 'BOT-DEVICE-' ELSE 'DEVICE-' END)
    || CAST(k AS VARCHAR) AS deviceId,
  (k % 7 = 0 OR (event_type = 'error' AND k % 2 = 0)) AS rapidFire,
  k AS sequence, value > 400 AS unusualAmount, event_id, user_id
FROM ev""")

cte("prof", [], """
SELECT 'CUST-' || CAST(c_custkey AS VARCHAR) AS p_customerId,
  round(c_acctbal / 25, 2) AS p_avg, c_acctbal AS p_limit,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['GROCERY', 'GAS_STATION'] WHEN 'BUILDING' THEN ['RETAIL', 'ONLINE']
       WHEN 'FURNITURE' THEN ['RESTAURANT', 'RETAIL'] WHEN 'HOUSEHOLD' THEN ['GROCERY', 'ONLINE']
       ELSE ['ONLINE', 'RETAIL'] END AS p_categories,
  'NATION_' || CAST(c_custkey % 25 AS VARCHAR) AS p_home,
  CASE WHEN c_acctbal < 2000 THEN 'HIGH' WHEN c_acctbal < 6000 THEN 'MEDIUM' ELSE 'LOW' END AS p_risk
FROM customer WHERE c_acctbal >= 0""")


def _velocity(size: str) -> str:
    return f"""
SELECT *, count(*) OVER (PARTITION BY customerId, time_bucket(INTERVAL '{size}', "timestamp")
  ORDER BY "timestamp", transactionId ROWS UNBOUNDED PRECEDING) AS velocityCount FROM txn"""


cte("vel", ["txn"], _velocity("1 day"))
cte("vel5", ["txn"], _velocity("5 minutes"))
for suffix in ("", "5"):
    cte(f"enr{suffix}", [f"vel{suffix}", "prof"], f"""
SELECT v.*, p.*, p_customerId IS NOT NULL AS has_profile
FROM vel{suffix} v LEFT JOIN prof p ON v.customerId = p.p_customerId""")
    cte(f"feat{suffix}", [f"enr{suffix}"], f"""
SELECT *,
  {R('CASE WHEN avg_a > 0 THEN amount / avg_a ELSE 1.0 END', 4)} AS amount_ratio,
  {R('CASE WHEN lim_a > 0 THEN amount / lim_a ELSE 0.0 END', 4)} AS daily_limit_ratio,
  {FLAG.format("amount > avg_a * 3")} AS is_amount_unusual,
  v_eff AS velocity_count, v_eff * v_eff AS velocity_squared,
  {FLAG.format("v_eff >= 3")} AS is_high_velocity,
  {FLAG.format("contains(lower(location), 'unknown')")} AS is_unknown_location,
  {FLAG.format("lower(location) = lower(home_a)")} AS is_primary_location,
  {FLAG.format("lower(location) <> lower(home_a) AND NOT contains(lower(location), 'unknown')")} AS is_different_city,
  {FLAG.format("merchantCategory = 'ONLINE'")} AS is_online,
  {FLAG.format("has_profile AND list_contains(p_categories, merchantCategory)")} AS is_typical_category,
  {FLAG.format("contains(lower(merchantId), 'suspicious')")} AS is_suspicious_merchant,
  CAST(hour("timestamp") AS INTEGER) AS hour,
  {FLAG.format('hour("timestamp") < 6 OR hour("timestamp") >= 22')} AS is_off_hours,
  {FLAG.format('isodow("timestamp") >= 6')} AS is_weekend,
  {FLAG.format("risk_a = 'HIGH'")} AS is_high_risk_customer,
  {FLAG.format("risk_a = 'LOW'")} AS is_low_risk_customer,
  {FLAG.format("contains(lower(deviceId), 'bot')")} AS is_bot_device,
  {FLAG.format("rapidFire")} AS is_rapid_fire
FROM (SELECT *, CASE WHEN has_profile THEN p_avg ELSE {D(100.0)} END AS avg_a,
        CASE WHEN has_profile THEN p_limit ELSE {D(1000.0)} END AS lim_a,
        CASE WHEN has_profile THEN p_risk ELSE 'UNKNOWN' END AS risk_a,
        CASE WHEN has_profile THEN p_home ELSE '' END AS home_a,
        CASE WHEN velocityCount IS NULL OR velocityCount = 0 THEN 1 ELSE velocityCount END AS v_eff
      FROM enr{suffix})""")


def _points(base: float, **gains: float) -> str:
    total = " + ".join([D(base)] + [f"{D(g)} * {flag}" for flag, g in gains.items()])
    return f"round(greatest({D(0.0)}, least({D(1.0)}, {total})), 4)"


def _bounded(text: str, digits: int = 4) -> str:
    return f"round(greatest({D(0.0)}, least({D(1.0)}, {text})), {digits})"


W = panel.WEIGHTS
for suffix in ("", "5"):
    cte(f"pan{suffix}", [f"feat{suffix}"], f"""
SELECT *,
  CASE WHEN is_high_velocity = 1 THEN {_bounded(f"pattern_risk + CASE WHEN is_bot_device = 1 OR is_rapid_fire = 1 THEN {D(0.1)} ELSE {D(-0.05)} END")} END AS pattern_fu,
  CASE WHEN is_high_velocity = 1 THEN {_bounded(f"temporal_risk + CASE WHEN is_bot_device = 1 OR is_rapid_fire = 1 THEN {D(0.1)} ELSE {D(-0.05)} END")} END AS temporal_fu,
  CASE WHEN has_profile THEN {_bounded(f"behavior_risk + CASE WHEN is_amount_unusual = 1 OR is_high_risk_customer = 1 THEN {D(0.05)} ELSE {D(-0.05)} END")} END AS behavior_fu,
  CASE WHEN has_profile THEN {_bounded(f"risk_risk + CASE WHEN is_amount_unusual = 1 OR is_high_risk_customer = 1 THEN {D(0.05)} ELSE {D(-0.05)} END")} END AS risk_fu,
  {_bounded(f'''(behavior_risk * {D(1.2)} + pattern_risk * {D(1.3)} + risk_risk * {D(1.1)} + geographic_risk * {D(1.0)} + temporal_risk * {D(1.0)}) / {D(sum((1.2, 1.3, 1.1, 1.0, 1.0)))}
    + CASE WHEN greatest(behavior_risk, pattern_risk, risk_risk, geographic_risk, temporal_risk) >= {D(0.8)} THEN {D(0.1)} ELSE {D(0.0)} END''', 3)} AS consensus_risk,
  CASE WHEN is_high_velocity = 1 AND is_bot_device = 1 AND is_rapid_fire = 1 THEN 'card_testing'
       WHEN is_bot_device = 1 AND is_unknown_location = 1 THEN 'vpn_bot_fraud'
       WHEN is_amount_unusual = 1 AND is_different_city = 1 THEN 'account_takeover'
       ELSE 'general_fraud' END AS fraudPattern
FROM (SELECT *,
  {_points(0.25, is_amount_unusual=0.3, is_high_velocity=0.3, is_typical_category=-0.15, is_rapid_fire=0.2)} AS behavior_risk,
  {_points(0.1, is_high_velocity=0.25, is_suspicious_merchant=0.25, is_bot_device=0.25, is_rapid_fire=0.2)} AS pattern_risk,
  {_points(0.1, is_amount_unusual=0.3, is_high_risk_customer=0.25, is_low_risk_customer=-0.05, is_high_velocity=0.2, is_suspicious_merchant=0.15)} AS risk_risk,
  {_points(0.1, is_unknown_location=0.55, is_different_city=0.3, is_suspicious_merchant=0.1, is_primary_location=-0.05)} AS geographic_risk,
  {_points(0.1, is_off_hours=0.2, is_high_velocity=0.3, is_rapid_fire=0.3, is_bot_device=0.1, is_weekend=0.05)} AS temporal_risk
  FROM feat{suffix})""")
    cte(f"base{suffix}", [f"pan{suffix}"], f"""
SELECT *,
  (behavior_risk * {D(1.2)} + pattern_risk * {D(1.3)} + risk_risk * {D(1.1)} + geographic_risk * {D(1.0)} + temporal_risk * {D(1.0)}
   + coalesce(pattern_fu * {D(1.3)}, 0) + coalesce(temporal_fu * {D(1.0)}, 0)
   + coalesce(behavior_fu * {D(1.2)}, 0) + coalesce(risk_fu * {D(1.1)}, 0) + consensus_risk * {D(0.8)})
  / ({D(1.2)} + {D(1.3)} + {D(1.1)} + {D(1.0)} + {D(1.0)}
   + CASE WHEN is_high_velocity = 1 THEN {D(1.3)} ELSE {D(0.0)} END + CASE WHEN is_high_velocity = 1 THEN {D(1.0)} ELSE {D(0.0)} END
   + CASE WHEN has_profile THEN {D(1.2)} ELSE {D(0.0)} END + CASE WHEN has_profile THEN {D(1.1)} ELSE {D(0.0)} END + {D(0.8)}) AS baseRisk,
  CASE WHEN is_high_velocity = 1 THEN {D(0.25)} ELSE {D(0.0)} END
   + CASE WHEN is_amount_unusual = 1 THEN {D(0.2)} ELSE {D(0.0)} END
   + CASE WHEN is_high_risk_customer = 1 THEN {D(0.1)} ELSE {D(0.0)} END AS streamingBonus,
  CAST(6 + CASE WHEN is_high_velocity = 1 THEN 2 ELSE 0 END + CASE WHEN has_profile THEN 2 ELSE 0 END AS INTEGER) AS agentCount,
  round(greatest(behavior_risk, pattern_risk, risk_risk, geographic_risk, temporal_risk)
   - least(behavior_risk, pattern_risk, risk_risk, geographic_risk, temporal_risk), 4) > {D(0.4)} AS hasDisagreement
FROM pan{suffix}""")
    cte(f"dec{suffix}", [f"base{suffix}"], f"""
SELECT *, CASE WHEN isFraudulent AND confidenceScore > {D(0.8)} THEN 'fraud-alerts'
  WHEN isFraudulent OR (confidenceScore > {D(0.3)} AND confidenceScore < {D(0.7)}) THEN 'human-review'
  ELSE 'approved-transactions' END AS route
FROM (SELECT *, least({D(1.0)}, baseRisk + streamingBonus) AS finalRiskScore,
        least({D(1.0)}, baseRisk + streamingBonus) >= {D(0.6)} AS isFraudulent,
        round(consensus_risk, 3) AS confidenceScore FROM base{suffix})""")

CARD = [
    ("is_amount_unusual", 1.0), ("is_high_velocity", 1.2), ("is_unknown_location", 0.9), ("is_different_city", 0.4),
    ("is_online", 0.2), ("is_typical_category", -0.5), ("is_suspicious_merchant", 1.1), ("is_off_hours", 0.4),
    ("is_high_risk_customer", 0.5), ("is_low_risk_customer", -0.4), ("is_bot_device", 1.3), ("is_rapid_fire", 1.0),
]
cte("sco", ["dec"], f"""
SELECT *, round(1 / (1 + exp(-({D(-3.0)} + {" + ".join(f"{D(w)} * {f}" for f, w in CARD)}))), 4) AS mlFraudScore,
  sequence + 40 AS latencyMs FROM dec""")

cte("lab", [], """
SELECT 'TXN-' || CAST(doc_id AS VARCHAR) AS labelledId, toxic = 1 AS actualFraud, quality = 1 AS qualityLabel FROM labels""")

cte("fb", ["dec", "lab"], """
SELECT transactionId, isFraudulent AS predictedFraud, actualFraud, confidenceScore AS confidence,
  agentCount AS agentConsensus, fraudPattern,
  CASE WHEN labelledId IS NOT NULL THEN 'ANALYST' ELSE 'AUTO_SYSTEM' END AS source,
  "timestamp" + to_seconds(sequence * 6) AS feedbackAt,
  CASE WHEN labelledId IS NOT NULL THEN 'ANALYST-' || CAST(sequence % 7 AS VARCHAR) END AS analystId,
  CASE WHEN labelledId IS NOT NULL THEN sequence * 6 END AS reviewTimeSeconds, event_id
FROM dec LEFT JOIN lab ON dec.transactionId = lab.labelledId""")

cte("pair", ["sco", "fb"], """
SELECT s.* EXCLUDE (fraudPattern), f.predictedFraud, f.actualFraud, f.confidence, f.agentConsensus, f.fraudPattern,
  f.source, f.feedbackAt, f.analystId, f.reviewTimeSeconds
FROM sco s JOIN fb f ON s.transactionId = f.transactionId""")

EMBED = """CASE WHEN actualFraud IS NOT NULL THEN actualFraud
  ELSE predictedFraud AND round(confidence, 4) >= CAST(0.7 AS DOUBLE) END"""
WARM = "NOT (velocity_count <= 2 AND mlFraudScore < CAST(0.1 AS DOUBLE))"

# --- audit tables ---------------------------------------------------------

cte("a_txn", ["feat"], """
SELECT transactionId AS transaction_id, customerId AS customer_id, CAST(amount AS DECIMAL(12,2)) AS amount,
  merchantId AS merchant_id, merchantCategory AS merchant_category, location, deviceId AS device_id,
  "timestamp", CAST(velocityCount AS INTEGER) AS velocity_5min,
  CAST(p_avg AS DECIMAL(12,2)) AS avg_transaction_amount, event_id FROM feat""")
cte("a_pred", ["sco"], """
SELECT event_id AS id, transactionId AS transaction_id, 'xgboost' AS model_type,
  CAST(mlFraudScore AS DECIMAL(5,4)) AS prediction_score, CAST(latencyMs AS INTEGER) AS prediction_time_ms,
  "timestamp" AS predicted_at, 'card-v1' AS model_version FROM sco""")
OUTCOME = """CASE WHEN actualFraud THEN 'CONFIRMED_FRAUD' WHEN NOT actualFraud THEN 'FALSE_POSITIVE'
  WHEN predictedFraud THEN 'CONFIRMED_FRAUD' ELSE 'LEGITIMATE' END"""
LEVEL = f"CASE WHEN confidence >= {D(0.8)} THEN 'HIGH' WHEN confidence >= {D(0.6)} THEN 'MEDIUM' ELSE 'LOW' END"
cte("a_rev", ["fb"], f"""
SELECT event_id AS id, transactionId AS transaction_id, coalesce(analystId, 'system') AS analyst_id,
  {OUTCOME} AS review_outcome,
  'Pattern: ' || fraudPattern || ', Confidence: ' || printf('%.2f', confidence) AS notes,
  CAST(reviewTimeSeconds AS INTEGER) AS time_to_review_seconds, feedbackAt AS reviewed_at, predictedFraud, actualFraud,
  {LEVEL} AS confidence_level FROM fb""")

# --- vectors --------------------------------------------------------------

cte("vec", [], "SELECT vec_id AS id, embedding, 'CUST-' || CAST(vec_id % 20 AS VARCHAR) AS customerId, label FROM embeddings")
cte("sims", ["vec"], """
SELECT a.id AS queryId, b.id AS caseId, a.customerId AS qc, b.customerId AS cc,
  list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
FROM vec a JOIN vec b ON a.id <> b.id""")
cte("cand", ["sims"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queryId ORDER BY round(score, 9) DESC, caseId) AS candidateRank FROM sims)
WHERE candidateRank <= 20""")


def _hits(threshold: float) -> str:
    return f"""
SELECT queryId, caseId, round(score, 4) AS similarity, CAST("rank" AS INTEGER) AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY queryId ORDER BY CASE WHEN qc = cc THEN 0 ELSE 1 END, round(score, 9) DESC, caseId) AS "rank"
  FROM cand) WHERE "rank" <= 3 AND round(score, 4) >= {D(threshold)}"""


cte("hits40", ["cand"], _hits(0.40))
cte("hits10", ["cand"], _hits(0.10))
PATTERN_OF = "CASE {0} % 4 WHEN 0 THEN 'card_testing' WHEN 1 THEN 'vpn_bot_fraud' WHEN 2 THEN 'account_takeover' ELSE 'general_fraud' END"
cte("vcase", ["vec"], f"""
SELECT id, 'fraud pattern: ' || {PATTERN_OF.format("label")} || chr(10) || '{tx.CASE_INDENT}case label: ' || CAST(label AS VARCHAR) AS document,
  'TXN-' || CAST(id AS VARCHAR) AS transactionId, customerId, {PATTERN_OF.format("label")} AS fraudPattern,
  round(label * {D(0.03)} + {D(0.7)}, 2) AS confidence,
  CASE WHEN label < 5 THEN 'human_analyst' ELSE 'system' END AS confirmedBy FROM vec""")
cte("ctx", ["hits10", "vcase"], f"""
SELECT queryId, CAST(count(*) AS INTEGER) AS casesFound, max(similarity) AS maxSimilarity,
  max(CASE WHEN "rank" = 1 THEN similarity END) AS sim1, max(CASE WHEN "rank" = 1 THEN fraudPattern END) AS pat1,
  {q(tx.CASE_HEADER)} || chr(10) || chr(10)
  || string_agg('Case ' || CAST(pos AS VARCHAR) || ' (similarity: ' || CAST(CAST(trunc(similarity * 100) AS INTEGER) AS VARCHAR)
     || '%, pattern: ' || fraudPattern || ', confidence: ' || printf('%.2f', confidence) || ', txn: ...' || right(transactionId, 8)
     || ', confirmed: 2024-01-15, by: ' || confirmedBy || '):' || chr(10)
     || '  ' || replace(document, chr(10), chr(10) || '  ') || chr(10), chr(10) ORDER BY pos)
  || chr(10) || {q(tx.CASE_FOOTER)} AS promptContext,
  string_agg(left(document, 200), '|' ORDER BY pos) AS summaries
FROM (SELECT h.*, v.* EXCLUDE (id), row_number() OVER (PARTITION BY queryId ORDER BY "rank") AS pos
      FROM hits10 h JOIN vcase v ON h.caseId = v.id) GROUP BY queryId""")
cte("feed", ["pair", "ctx"], f"""
SELECT p.feedbackAt AS "time", p.transactionId, right(p.transactionId, 8) AS txnShort, p.customerId,
  {R('p.mlFraudScore * 100', 1)} AS mlScorePct, coalesce(c.casesFound, 0) AS ragCases,
  CASE WHEN coalesce(c.casesFound, 0) > 0 THEN {R('c.simTop * 100', 1)} ELSE 0 END AS topSimilarityPct,
  CASE WHEN p.fraudPattern IS NOT NULL AND p.fraudPattern NOT IN ('', 'unknown') THEN p.fraudPattern
       WHEN coalesce(c.casesFound, 0) > 0 THEN c.patTop ELSE '—' END AS topPattern,
  p.agentConsensus AS agents, {R('p.confidence * 100', 1)} AS confidencePct,
  CASE WHEN p.predictedFraud AND p.confidence >= CAST(0.8 AS DOUBLE) THEN 'FRAUD' WHEN p.predictedFraud THEN 'REVIEW' ELSE 'APPROVED' END AS decision
FROM pair p LEFT JOIN (
  SELECT DISTINCT queryId, casesFound, first_value(similarity) OVER w AS simTop, first_value(fraudPattern) OVER w AS patTop
  FROM (SELECT h.queryId, h.similarity, h."rank", v.fraudPattern, x.casesFound FROM hits10 h JOIN vcase v ON h.caseId = v.id
        JOIN ctx x ON x.queryId = h.queryId)
  WINDOW w AS (PARTITION BY queryId ORDER BY "rank")) c
ON p.transactionId = 'TXN-' || CAST(c.queryId AS VARCHAR)""")
