"""Queries on the panel, decisions, routing, payloads and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import prompts, text as tx
from riskloom.operators import panel, routing
from riskloom.plans.context_queries import SCORED_CONTEXT_SQL
from riskloom.plans.frames import Frames
from riskloom.plans.oracle import CARD, D, W, build, cte, q
from riskloom.plans.registry import query


def route_counts_of(frames: Frames) -> DataFrame:
    return frames.decided().groupBy("route").agg(
        F.count(F.lit(1)).alias("decisions"), F.sum(F.col("isFraudulent").cast("long")).alias("fraudulent"))


_COUNTS = """SELECT route, count(*) AS decisions, CAST(sum(CASE WHEN isFraudulent THEN 1 ELSE 0 END) AS BIGINT) AS fraudulent
FROM {0} GROUP BY route"""


@query(build(_COUNTS.format("dec"), "dec"))
def route_counts_day(f: Frames) -> DataFrame:
    return route_counts_of(f)


@query(build(_COUNTS.format("dec5"), "dec5"), size="5 minutes")
def route_counts(f: Frames) -> DataFrame:
    return route_counts_of(f)


_DECISION = ["transactionId", "isFraudulent", "confidenceScore", "fraudPattern", "agentCount", "hasDisagreement", "route"]
_DECISION_SQL = ", ".join(_DECISION)


@query(build(f"SELECT {_DECISION_SQL}, round(baseRisk, 6) AS baseRisk, streamingBonus, round(finalRiskScore, 6) AS finalRiskScore FROM dec", "dec"))
def decisions_day(f: Frames) -> DataFrame:
    return f.decided().select(*_DECISION, F.round("baseRisk", 6).alias("baseRisk"), "streamingBonus",
                              F.round("finalRiskScore", 6).alias("finalRiskScore"))


@query(build(f"SELECT {_DECISION_SQL}, round(baseRisk, 6) AS baseRisk, streamingBonus, round(finalRiskScore, 6) AS finalRiskScore FROM dec5", "dec5"), size="5 minutes")
def decisions(f: Frames) -> DataFrame:
    return f.decided().select(*_DECISION, F.round("baseRisk", 6).alias("baseRisk"), "streamingBonus",
                              F.round("finalRiskScore", 6).alias("finalRiskScore"))


# --- long-form insights ---------------------------------------------------

_ANSWERS = [
    ("BEHAVIOR_ANALYST", "first", "behavior_risk"), ("PATTERN_DETECTOR", "first", "pattern_risk"),
    ("RISK_ASSESSOR", "first", "risk_risk"), ("GEOGRAPHIC_ANALYST", "first", "geographic_risk"),
    ("TEMPORAL_ANALYST", "first", "temporal_risk"), ("PATTERN_DETECTOR", "velocity", "pattern_fu"),
    ("TEMPORAL_ANALYST", "velocity", "temporal_fu"), ("BEHAVIOR_ANALYST", "profile", "behavior_fu"),
    ("RISK_ASSESSOR", "profile", "risk_fu"), ("STREAMING_CONSENSUS_COORDINATOR", "consensus", "consensus_risk"),
]
_SIGNALS = {
    "BEHAVIOR_ANALYST": ["is_amount_unusual", "is_high_velocity", "is_typical_category", "is_rapid_fire"],
    "PATTERN_DETECTOR": ["is_high_velocity", "is_suspicious_merchant", "is_bot_device", "is_rapid_fire"],
    "RISK_ASSESSOR": ["is_amount_unusual", "is_high_risk_customer", "is_low_risk_customer", "is_high_velocity",
                      "is_suspicious_merchant"],
    "GEOGRAPHIC_ANALYST": ["is_unknown_location", "is_different_city", "is_suspicious_merchant", "is_primary_location"],
    "TEMPORAL_ANALYST": ["is_off_hours", "is_high_velocity", "is_rapid_fire", "is_bot_device", "is_weekend"],
}


def _reason_sql(agent: str) -> str:
    if agent not in _SIGNALS:
        return "'panel consensus: ' || fraudPattern"
    raised = ", ".join(f"CASE WHEN {s} = 1 THEN '{s[3:].replace('_', ' ')}' END" for s in _SIGNALS[agent])
    return f"coalesce('signals: ' || nullif(concat_ws(', ', {raised}), ''), 'no signals')"


def _code_sql(risk: str) -> str:
    return (f"CASE WHEN {risk} >= {D(0.8)} THEN 'FRAUD_ALERT' WHEN {risk} >= {D(0.6)} THEN 'HUMAN_REVIEW' "
            "ELSE 'APPROVE' END")


def insights_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT transactionId, '{a}' AS agentName, '{r}' AS "round", {c} AS riskScore, {D(W[a])} AS weight,
  {_reason_sql(a)} AS reasoning, {_code_sql(c)} AS recommendation,
  {"fraudPattern" if r == "consensus" else "'unknown'"} AS pattern, {i} AS seq FROM {source} WHERE {c} IS NOT NULL"""
        for i, (a, r, c) in enumerate(_ANSWERS))


@query(build(f"SELECT * EXCLUDE (seq) FROM ({insights_sql('pan')})", "pan"))
def panel_insights(f: Frames) -> DataFrame:
    """One row per answer: first round, follow-ups and consensus."""
    return panel.long_insights(f.paneled()).drop("confidence")


@query(build(f"""
SELECT "round", count(*) AS insights, round(avg(riskScore), 6) AS avgRisk FROM ({insights_sql('pan')}) GROUP BY "round" """, "pan"))
def all_insights(f: Frames) -> DataFrame:
    """First round, follow-ups and consensus put together again from separate sets."""
    rows = panel.long_insights(f.paneled())
    united = panel.all_insights(*[rows.where(F.col("round") == r) for r in ("first", "velocity", "profile", "consensus")])
    return united.groupBy("round").agg(F.count(F.lit(1)).alias("insights"), F.round(F.avg("riskScore"), 6).alias("avgRisk"))


@query(build(f"SELECT transactionId, isFraudulent, confidenceScore, fraudPattern, agentCount, hasDisagreement, round(finalRiskScore, 6) AS finalRiskScore FROM dec", "dec"))
def decisions_from_long_form(f: Frames) -> DataFrame:
    """The decision from insight rows alone, as for externally produced answers."""
    from riskloom.operators.enrich import flatten_enriched

    paneled = f.paneled()
    decided = panel.decide_long(panel.long_insights(paneled), flatten_enriched(paneled))
    return decided.select("transactionId", "isFraudulent", "confidenceScore", "fraudPattern", "agentCount",
                          "hasDisagreement", F.round("finalRiskScore", 6).alias("finalRiskScore"))


_RISKS = [c for _, _, c in _ANSWERS]


@query(build(f"""
SELECT transactionId, round(share, 6) AS share, CASE WHEN share >= {D(0.8)} THEN {D(0.9)} WHEN share >= {D(0.6)} THEN {D(0.7)}
  WHEN share >= {D(0.4)} THEN {D(0.5)} ELSE {D(0.3)} END AS tier
FROM (SELECT transactionId, CAST({" + ".join(f"CASE WHEN ({c} >= {D(0.6)}) = isFraudulent THEN 1 ELSE 0 END" for c in _RISKS)} AS DOUBLE)
  / ({" + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _RISKS)}) AS share FROM dec)""", "dec"))
def agreement_confidence(f: Frames) -> DataFrame:
    """The fallback confidence: share of answers agreeing with the verdict, and its tier."""
    share = F.col("share")
    decided = f.decided().withColumn("share", panel.agreement_share())
    return decided.select("transactionId", F.round(share, 6).alias("share"), panel.agreement_tier(share).alias("tier"))


@query(build(f"""
SELECT transactionId, {_code_sql('confidenceScore')} AS recommendation,
  CASE WHEN confidenceScore >= {D(0.8)} THEN 'BLOCK' WHEN confidenceScore >= {D(0.6)} THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
  'APPROVE' AS legacyDecision FROM dec""", "dec"))
def recommendation_codes(f: Frames) -> DataFrame:
    confidence = F.col("confidenceScore")
    return f.decided().select(
        "transactionId", panel.recommendation(confidence).alias("recommendation"),
        routing.audit_decision(confidence).alias("decision"),
        routing.audit_decision(confidence, legacy=True).alias("legacyDecision"))


# --- decision records, payloads ---------------------------------------------

def _records(f: Frames) -> DataFrame:
    return panel.to_decision_record(f.investigated(), F.col("mlFraudScore"), F.col("casesFound"), F.col("context"))


# What a decision was made on: streaming context with the retrieved cases, and the largest contributions.
cte("inv", ["sco", "ctx"], f"""
SELECT s.*, coalesce(c.casesFound, 0) AS casesFound, c.maxSimilarity, concat_ws(chr(10), {SCORED_CONTEXT_SQL}, c.promptContext) AS context
FROM sco s LEFT JOIN ctx c ON s.event_id = c.queryId""")
_PARTS = " UNION ALL ".join(
    f"SELECT transactionId, '{name}' AS feature, {D(w)} * ({name} - (SELECT avg({name}) FROM feat)) AS value FROM feat" for name, w in CARD)
cte("att", ["feat"], f"""
SELECT transactionId, string_agg(feature || ':' || printf('%.6f', value), ',' ORDER BY place) AS topFeatures FROM (
  SELECT *, row_number() OVER (PARTITION BY transactionId ORDER BY round(abs(value), 9) DESC, feature) AS place FROM ({_PARTS}))
WHERE place <= 3 GROUP BY transactionId""")


_SHORT_TXN_SQL = """'ID: ' || transactionId || chr(10) || 'Amount: $' || CAST(amount AS VARCHAR) || ' ' || currency || chr(10)
  || 'Merchant: ' || merchantId || ' (' || merchantCategory || ')' || chr(10) || 'Location: ' || location || chr(10)
  || 'Device: ' || deviceId || chr(10) || 'Rapid fire: ' || CASE WHEN rapidFire THEN 'True' ELSE 'False' END"""
_INSIGHT_LINES = f"""SELECT transactionId, string_agg('- ' || agentName || ' (Risk: ' || printf('%.1f', riskScore * 100) || '%): '
    || left(reasoning, 150), chr(10) ORDER BY seq) AS lines FROM ({insights_sql('sco')}) GROUP BY transactionId"""
EXPLANATION_SQL = f"""{q(tx.EXPLANATION_TITLE)} || chr(10) || 'TRANSACTION:' || chr(10) || {_SHORT_TXN_SQL} || chr(10) || chr(10)
  || 'STREAMING CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'AGENT ANALYSIS:' || chr(10) || l.lines
  || chr(10) || chr(10) || 'FINAL RISK SCORE: ' || printf('%.1f', finalRiskScore * 100) || '%' || chr(10) || 'DECISION: '
  || CASE WHEN isFraudulent THEN 'FRAUD DETECTED' ELSE 'LEGITIMATE' END"""
RECORD_SQL = f"""SELECT s.*, {EXPLANATION_SQL} AS explanation,
  CASE WHEN isFraudulent THEN 'AI agents with streaming intelligence detected fraud' ELSE 'Transaction appears legitimate' END AS reason,
  CAST(floor(confidenceScore * 100 + {D(0.5)}) AS BIGINT) AS pct, CAST(epoch_us("timestamp") // 1000 AS BIGINT) AS ms
FROM inv s JOIN ({_INSIGHT_LINES}) l USING (transactionId)"""
cte("rec", ["inv"], RECORD_SQL)
cte("a_dec", ["rec", "att"], f"""
SELECT event_id AS id, transactionId AS transaction_id, CAST(mlFraudScore AS DECIMAL(5,4)) AS ml_score, a.topFeatures AS shap_top_features,
  CAST(CAST(confidenceScore AS DECIMAL(6,3)) AS DECIMAL(5,2)) AS llm_confidence, fraudPattern AS fraud_pattern,
  explanation AS reasoning,
  CASE WHEN confidenceScore >= {D(0.8)} THEN 'FRAUD_ALERT' WHEN confidenceScore >= {D(0.6)} THEN 'HUMAN_REVIEW' ELSE 'APPROVE' END AS recommendation,
  casesFound > 0 AS rag_context_used,
  CASE WHEN casesFound > 0 THEN CAST(maxSimilarity AS DECIMAL(5,4)) END AS rag_similarity_score,
  CAST(casesFound AS INTEGER) AS rag_cases_retrieved,
  CASE WHEN confidenceScore >= {D(0.8)} THEN 'BLOCK' WHEN confidenceScore >= {D(0.6)} THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
  "timestamp" AS decided_at
FROM rec JOIN att a USING (transactionId)""")


@query(build(f"SELECT transactionId, explanation FROM rec", "rec"))
def explanations(f: Frames) -> DataFrame:
    return _records(f).select("transactionId", F.col("detailedExplanation").alias("explanation"))


@query(build(f"""
SELECT transactionId, isFraudulent, confidenceScore, reason AS primaryReason, md5(explanation) AS explanationHash,
  agentCount AS insights, round(finalRiskScore, 6) AS finalRisk, mlFraudScore AS mlScore, CAST(casesFound AS DOUBLE) AS casesFound, fraudPattern
FROM rec""", "rec"))
def decision_records(f: Frames) -> DataFrame:
    factors = F.col("riskFactors")
    return _records(f).select(
        "transactionId", "isFraudulent", "confidenceScore", "primaryReason",
        F.md5("detailedExplanation").alias("explanationHash"), F.size("agentInsights").alias("insights"),
        F.round(factors["finalRiskScore"], 6).alias("finalRisk"), factors["mlFraudScore"].alias("mlScore"),
        factors["ragCasesFound"].alias("casesFound"), "fraudPattern")


def _at() -> object:
    """Payload time: the decision's own time, so results repeat."""
    return F.unix_millis(F.col("analyzedAt").cast("timestamp"))


@query(build(f"""
SELECT 'AI_FRAUD_ALERT' AS type, transactionId, pct AS confidence, fraudPattern, reason, agentCount,
  explanation AS aiExplanation, ms AS "timestamp", 'HIGH' AS priority FROM rec WHERE route = 'fraud-alerts'""", "rec"))
def alert_payloads(f: Frames) -> DataFrame:
    return routing.alert_payload(routing.split(_records(f))[routing.ALERT], _at())


@query(build(f"""
SELECT 'AI_REVIEW_CASE' AS type, transactionId, pct AS confidence, fraudPattern, explanation, agentCount AS insights,
  'PENDING_HUMAN_REVIEW' AS status, ms AS "timestamp" FROM rec WHERE route = 'human-review'""", "rec"))
def review_payloads(f: Frames) -> DataFrame:
    payload = routing.review_payload(routing.split(_records(f))[routing.REVIEW], _at())
    return payload.withColumn("insights", F.size("agentInsights")).drop("agentInsights")


@query(build(f"""
SELECT 'AI_APPROVAL' AS type, transactionId, pct AS confidence, 'APPROVED_BY_AI' AS status, agentCount,
  ms AS "timestamp" FROM rec WHERE route = 'approved-transactions'""", "rec"))
def approval_payloads(f: Frames) -> DataFrame:
    return routing.approval_payload(routing.split(_records(f))[routing.APPROVED], _at())


@query(build(f"""
SELECT transactionId, isFraudulent AS predictedFraud, confidenceScore AS confidence, fraudPattern,
  agentCount AS agentConsensus, CAST(epoch_us("timestamp") // 1000 AS BIGINT) AS "timestamp", 'AUTO_SYSTEM' AS source FROM dec""", "dec"))
def feedback_records(f: Frames) -> DataFrame:
    return routing.feedback_record(_records(f), _at())


@query(build("SELECT count(*) AS inputRows, count(*) AS routedRows, CAST(0 AS BIGINT) AS routedTwice FROM dec", "dec"))
def split_check(f: Frames) -> DataFrame:
    """The three parts are disjoint and complete."""
    decided = f.decided()
    parts = None
    for part in routing.split(decided).values():
        rows = part.select("transactionId")
        parts = rows if parts is None else parts.unionByName(rows)
    per_id = parts.groupBy("transactionId").agg(F.count(F.lit(1)).alias("n"))
    routed = per_id.agg(F.sum("n").alias("routedRows"), F.count(F.when(F.col("n") > 1, 1)).alias("routedTwice"))
    whole = decided.agg(F.count(F.lit(1)).alias("inputRows"))
    one = F.lit(1)
    return whole.withColumn("_one", one).join(F.broadcast(routed.withColumn("_one", one)), "_one").select(
        "inputRows", "routedRows", "routedTwice")


# --- prompts ----------------------------------------------------------------

_LONG_TXN_SQL = """'Transaction ID: ' || transactionId || chr(10) || 'Amount: $' || CAST(amount AS VARCHAR) || ' ' || currency || chr(10)
  || 'Merchant: ' || merchantId || ' (' || merchantCategory || ')' || chr(10) || 'Location: ' || location || chr(10)
  || 'Device: ' || deviceId || chr(10) || 'Channel: ' || CASE WHEN merchantCategory = 'ONLINE' THEN 'ONLINE' ELSE 'IN_STORE' END || chr(10)
  || 'Rapid fire: ' || CASE WHEN rapidFire THEN 'True' ELSE 'False' END || chr(10)"""


def _analysis_sql(name: str, context: str) -> str:
    w = prompts.WORDING[name]
    asked = "\n".join(f"{n}. {t}" for n, t in enumerate(w.questions, 1))
    header = tx.CASE_HEADER.rstrip(":")
    return " || ".join([
        q(f"You are a {w.title} {w.role}.\n\nSTREAMING INTELLIGENCE:\n"), context, q("\n\nTRANSACTION:\n"), _LONG_TXN_SQL,
        q(f"\nAnalyze:\n{asked}\n"),
        f"CASE WHEN contains({context}, '{header}') THEN {q(prompts.precedent_line(w))} ELSE '' END",
        q(prompts.RESPONSE_FORMAT)])


@query(build("SELECT transactionId, agentName, length(prompt) AS characters, md5(prompt) AS promptHash FROM (" + " UNION ALL ".join(
    f"SELECT transactionId, '{a.name}' AS agentName, {_analysis_sql(a.name, 'context')} AS prompt FROM inv" for a in panel.AGENTS)
    + ")", "inv"))
def agent_prompts(f: Frames) -> DataFrame:
    asked = prompts.agent_prompts(f.investigated())
    return asked.select("transactionId", "agentName", F.length("prompt").cast("long").alias("characters"),
                        F.md5("prompt").alias("promptHash"))


def _follow_sql(name: str, question: str) -> str:
    w = prompts.WORDING[name]
    return " || ".join([q(f"Desk: {w.title}.\nOpen question on this payment:\n\n"), question, q("\n\nTRANSACTION:\n"), _LONG_TXN_SQL,
                        q(f"\nKeep to {w.focus}.\n"), q(prompts.RESPONSE_FORMAT)])


_VELOCITY_Q = "'The current window holds ' || CAST(velocityCount AS VARCHAR) || ' payments of this customer. Would you expect that from a person?'"
_PROFILE_Q = "'This customer pays $' || printf('%.0f', p_avg) || ' on average and is rated ' || p_risk || '. What does that change for you?'"
_FIRST_LINES = " || chr(10) || ".join(
    f"'{a} (Risk: ' || printf('%.2f', {c}) || '): ' || left({_reason_sql(a)}, 200)" for a, r, c in _ANSWERS if r == "first")
_CONSENSUS = " || ".join([
    q("Close this case for the desk.\n\nSTREAMING CONTEXT:\n"), "context", q("\n\nTRANSACTION:\n"), _SHORT_TXN_SQL,
    q("\n\nAGENT FINDINGS:\n"), _FIRST_LINES,
    q("\n\nSet what the stream shows, what the desk found and what earlier cases proved against each other."), q(prompts.RESPONSE_FORMAT),
    q("\nPATTERN: [" + "|".join(S.PATTERNS) + "]")])
_FOLLOW = " UNION ALL ".join(
    [f"SELECT transactionId, 'velocity' AS \"round\", '{n}' AS agentName, {_follow_sql(n, _VELOCITY_Q)} AS prompt FROM inv WHERE is_high_velocity = 1"
     for n in panel.VELOCITY_ROUND]
    + [f"SELECT transactionId, 'profile', '{n}', {_follow_sql(n, _PROFILE_Q)} FROM inv WHERE has_profile" for n in panel.PROFILE_ROUND]
    + [f"SELECT transactionId, 'consensus', '{panel.CONSENSUS}', {_CONSENSUS} FROM inv"])


@query(build(f'SELECT transactionId, "round", agentName, length(prompt) AS characters, md5(prompt) AS promptHash FROM ({_FOLLOW})', "inv"))
def follow_up_prompts(f: Frames) -> DataFrame:
    asked = prompts.follow_up_prompts(f.investigated())
    return asked.select("transactionId", "round", "agentName", F.length("prompt").cast("long").alias("characters"),
                        F.md5("prompt").alias("promptHash"))


# --- parsing responses --------------------------------------------------------

_RESPONSE_SQL = """CASE (conv_id + turn) % 5 WHEN 0 THEN "text"
  WHEN 1 THEN 'RISK_SCORE: ' || printf('%.2f', (conv_id % 90) / 100.0) || chr(10) || 'REASONING: ' || "text" || chr(10) || 'RECOMMENDATION: HUMAN_REVIEW' || chr(10) || 'PATTERN: card_testing'
  WHEN 2 THEN 'risk_score: 0.4 reasoning: ' || "text" || ' recommendation: approve'
  WHEN 3 THEN 'RISK_SCORE: 1.7' || chr(10) || 'REASONING: short. RECOMMENDATION: FRAUD_ALERT' || chr(10) || 'PATTERN: other'
  ELSE 'RISK_SCORE: 0.5.1' || chr(10) || 'PATTERN: general_fraud' || chr(10) || "text" END"""


def _words_sql(pattern: str) -> str:
    return f"regexp_replace(regexp_extract(response, '{pattern}', 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@query(f"""
SELECT conv_id, turn, greatest({D(0.0)}, least({D(1.0)}, coalesce(TRY_CAST(nullif(regexp_extract(response, '(?i)RISK_SCORE:\\s*([0-9.]+)', 1), '') AS DOUBLE), {D(0.5)}))) AS riskScore,
  {_words_sql("(?im)REASONING:\\s*([^\\n]+?)(?:RECOMMENDATION:|PATTERN:|$)")} AS reasoning,
  {_words_sql("(?im)RECOMMENDATION:\\s*([^\\r\\n]+)")} AS recommendation,
  coalesce(nullif({_words_sql("(?im)PATTERN:\\s*(card_testing|vpn_bot_fraud|account_takeover|general_fraud)")}, ''), 'unknown') AS pattern
FROM (SELECT conv_id, turn, {_RESPONSE_SQL} AS response FROM conversations)""")
def parsed_responses(f: Frames) -> DataFrame:
    """Agent responses parsed in bulk, including absent and malformed fields."""
    body, newline = F.col("text"), "\n"
    kind = (F.col("conv_id") + F.col("turn")) % 5
    response = (
        F.when(kind == 0, body)
        .when(kind == 1, tx.join_text("RISK_SCORE: ", tx.fixed((F.col("conv_id") % 90) / 100, 2), "\nREASONING: ", body,
                                      "\nRECOMMENDATION: HUMAN_REVIEW\nPATTERN: card_testing"))
        .when(kind == 2, tx.join_text("risk_score: 0.4 reasoning: ", body, " recommendation: approve"))
        .when(kind == 3, F.lit(newline.join(["RISK_SCORE: 1.7", "REASONING: short. RECOMMENDATION: FRAUD_ALERT", "PATTERN: other"])))
        .otherwise(tx.join_text("RISK_SCORE: 0.5.1\nPATTERN: general_fraud\n", body)))
    parsed = prompts.parse_agent_text(f.table("conversations").withColumn("response", response))
    return parsed.select("conv_id", "turn", "riskScore", "reasoning", "recommendation", "pattern")
