"""Queries on feedback pairing, the case store, retrieval and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import cases, cells, feedback, monitor, similarity
from riskloom.settings import Retrieval
from riskloom.plans.context_queries import lines_sql
from riskloom.plans.frames import Frames
from riskloom.plans.oracle import D, EMBED, LEVEL, OUTCOME, WARM, build
from riskloom.plans.registry import query


@query(build("""
SELECT transactionId, customerId, mlFraudScore, predictedFraud, confidence, fraudPattern, "timestamp" AS predictedAt, feedbackAt
FROM pair""", "pair"))
def paired_feedback(f: Frames) -> DataFrame:
    return f.paired().select("transactionId", "customerId", "mlFraudScore", "predictedFraud", "confidence",
                             "fraudPattern", "predictedAt", "feedbackAt")


@query(build("""
SELECT topic, count(*) AS messages, count(DISTINCT transactionId) AS transactions FROM (
  SELECT 'ml-predictions' AS topic, transactionId FROM sco UNION ALL SELECT 'analyst-feedback', transactionId FROM fb)
GROUP BY topic""", "sco", "fb"))
def tagged_union(f: Frames) -> DataFrame:
    united = feedback.union_tagged(f.predictions(), f.feedback())
    return united.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"),
                                       F.countDistinct("transactionId").alias("transactions"))


@query(build(f"""
SELECT transactionId, coalesce({EMBED}, FALSE) AS shouldEmbed, {WARM} AS notColdStart, {OUTCOME} AS reviewOutcome,
  {LEVEL} AS confidenceLevel, CASE WHEN actualFraud IS NOT NULL THEN 'human_analyst' ELSE 'system' END AS confirmedBy,
  CASE WHEN actualFraud IS NOT NULL THEN 'human_analyst' ELSE 'system_high_confidence' END AS confirmedByText
FROM pair""", "pair"))
def feedback_actions(f: Frames) -> DataFrame:
    return f.paired().select(
        "transactionId", feedback.should_embed().alias("shouldEmbed"),
        feedback.not_cold_start(F.col("velocity_count"), F.col("mlFraudScore")).alias("notColdStart"),
        feedback.review_outcome().alias("reviewOutcome"), feedback.confidence_level().alias("confidenceLevel"),
        feedback.confirmed_by().alias("confirmedBy"), tx.confirmed_by_text().alias("confirmedByText"))


@query(build("""
SELECT id, transaction_id, analyst_id, review_outcome, notes, time_to_review_seconds, reviewed_at, confidence_level,
  predictedFraud, actualFraud FROM a_rev""", "a_rev"))
def case_reviews(f: Frames) -> DataFrame:
    return f.audit_reviews().select(
        "id", "transaction_id", "analyst_id", "review_outcome", "notes", "time_to_review_seconds", "reviewed_at",
        "confidence_level", "evidence_sources.predictedFraud", "evidence_sources.actualFraud")


@query(build(f"""
SELECT transactionId, CAST(coalesce(actualFraud, predictedFraud, FALSE) AS INTEGER) AS label,
  CASE WHEN actualFraud IS NOT NULL THEN 'HUMAN_CONFIRMED' ELSE 'AUTO_PREDICTED' END AS labelSource,
  coalesce(confidence, {D(0.5)}) AS confidence, CAST(coalesce(agentConsensus, 0) AS DOUBLE) AS agent_consensus, coalesce(mlFraudScore, {D(0.5)}) AS ml_fraud_score,
  CASE WHEN source = 'AUTO_SYSTEM' THEN {D(1.0)} ELSE {D(0.0)} END AS source_auto
FROM (SELECT f.*, s.mlFraudScore FROM (
    SELECT transactionId, actualFraud, predictedFraud, confidence, agentConsensus, source FROM fb
    UNION ALL SELECT labelledId, actualFraud, NULL, NULL, NULL, 'ANALYST' FROM lab
      WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fb.transactionId = lab.labelledId)) f
  LEFT JOIN sco s ON f.transactionId = s.transactionId)""", "fb", "sco", "lab"))
def online_features(f: Frames) -> DataFrame:
    """Labels and inputs of the online model for all feedback; without a prediction the score reads as 0.5."""
    inputs = feedback.feedback_features()
    return feedback.resolve_label(feedback.with_prediction_score(f.all_feedback(), f.predictions())).select(
        "transactionId", "label", "labelSource", *[c.alias(n) for n, c in inputs.items()])


# --- case store -----------------------------------------------------------

_CASE_GAP = f" || chr(10) || '{tx.CASE_INDENT}' || "
_CASE_SQL = f"""SELECT transactionId AS id, customerId, fraudPattern, confidence, mlFraudScore, velocity_count, is_high_velocity,
  is_bot_device, is_suspicious_merchant, CASE WHEN actualFraud IS NOT NULL THEN 'human_analyst' ELSE 'system' END AS confirmedBy,
  feedbackAt,
  {_CASE_GAP.join(["'fraud pattern: ' || fraudPattern", lines_sql(tx.CASE_INDENT),
    "'ml fraud score: ' || printf('%.3f', mlFraudScore)",
    "'agent consensus: ' || CAST(agentConsensus AS VARCHAR) || ' agents agreed'",
    "'decision confidence: ' || printf('%.2f', confidence)", "'outcome: FRAUD CONFIRMED'",
    "'confirmed by: ' || CASE WHEN actualFraud IS NOT NULL THEN 'human_analyst' ELSE 'system_high_confidence' END"])} AS document
FROM pair WHERE ({EMBED}) AND {WARM}"""


def _cases(f: Frames) -> DataFrame:
    return cases.confirmed_cases(f.paired(), F.col("feedbackAt"))


@query(build(f"""
SELECT id, document, customerId, fraudPattern, confidence, mlFraudScore, CAST(velocity_count AS INTEGER) AS velocityCount,
  is_high_velocity AS isHighVelocity, is_bot_device AS isBotDevice, is_suspicious_merchant AS isSuspiciousMerchant, confirmedBy,
  strftime(feedbackAt, '%Y-%m-%dT%H:%M:%S') AS embeddedAt FROM ({_CASE_SQL})""", "pair"))
def confirmed_cases(f: Frames) -> DataFrame:
    """Stored case text and metadata."""
    fields = ["customerId", "fraudPattern", "confidence", "mlFraudScore", "velocityCount", "isHighVelocity",
              "isBotDevice", "isSuspiciousMerchant", "confirmedBy", "embeddedAt"]
    return _cases(f).select("id", "document", *[f"metadata.{n}" for n in fields])


@query(build(f"""
SELECT id FROM ({_CASE_SQL}) WHERE id NOT IN (SELECT 'TXN-' || CAST(vec_id AS VARCHAR) FROM embeddings)""", "pair"))
def inserted_cases(f: Frames) -> DataFrame:
    """Confirmed cases whose id is not in the store yet."""
    stored = f.vectors().select(F.concat(F.lit("TXN-"), F.col("id").cast("string")).alias("id"))
    return cases.insert_if_absent(_cases(f), stored).select("id")


@query(build(f"SELECT fraudPattern, count(*) AS cases FROM ({_CASE_SQL}) GROUP BY fraudPattern", "pair"))
def case_pattern_counts(f: Frames) -> DataFrame:
    return cases.case_pattern_counts(_cases(f))


@query(build(f"SELECT count(*) AS totalCases FROM ({_CASE_SQL})", "pair"))
def case_store_stats(f: Frames) -> DataFrame:
    return cases.case_store_stats(_cases(f))


# --- retrieval --------------------------------------------------------------

@query(build('SELECT queryId, caseId, round(score, 4) AS similarity, CAST(candidateRank AS INTEGER) AS candidateRank FROM cand', "cand"))
def top_candidates(f: Frames) -> DataFrame:
    """Twenty nearest stored cases of every stored vector."""
    queries = f.vectors().select(F.col("id").alias("queryKey"), "vector")
    stored = f.vectors().select(F.col("id").alias("caseId"), "vector")
    fetch = Retrieval().fetch
    found = similarity.without_self(similarity.top_candidates(queries, stored, fetch + 1), "queryKey", fetch)
    return found.select(F.col("queryKey").alias("queryId"), "caseId", F.round("score", 4).alias("similarity"), "candidateRank")


@query(build('SELECT queryId, caseId, round(score, 4) AS similarity, CAST(candidateRank AS INTEGER) AS candidateRank FROM cand', "cand"))
def certified_candidates(f: Frames) -> DataFrame:
    """The same twenty through the cell index, complete by its bound."""
    queries = f.vectors().select(F.col("id").alias("queryKey"), "vector")
    stored = f.vectors().select(F.col("id").alias("caseId"), "vector")
    fetch = Retrieval().fetch
    found, _ = cells.certified_candidates(queries, stored, fetch + 1)
    told = similarity.without_self(found, "queryKey", fetch)
    return told.select(F.col("queryKey").alias("queryId"), "caseId", F.round("score", 4).alias("similarity"), "candidateRank")


@query(build("SELECT * FROM hits40", "hits40"))
def similar_cases(f: Frames) -> DataFrame:
    return f.hits(0.40)


@query(build("SELECT * FROM hits10", "hits10"))
def similar_cases_loose(f: Frames) -> DataFrame:
    return f.hits(0.10)


@query(build("SELECT queryId, casesFound, maxSimilarity, promptContext, summaries FROM ctx", "ctx"))
def retrieved_contexts(f: Frames) -> DataFrame:
    """Context of each query: count, best similarity, the numbered case block and summaries."""
    context = F.col("context")
    return f.contexts().select(
        "queryId", context["casesFound"].alias("casesFound"), cases.max_similarity(context).alias("maxSimilarity"),
        context["promptContext"].alias("promptContext"),
        F.array_join(F.transform(context["cases"], lambda c: c["summary"]), "|").alias("summaries"))


# --- monitoring -------------------------------------------------------------

@query(build("SELECT * FROM feed", "feed"))
def feed_records(f: Frames) -> DataFrame:
    return f.feed_records()


@query(build('SELECT * FROM feed ORDER BY "time" DESC, transactionId DESC LIMIT 100', "feed"))
def rolling_feed(f: Frames) -> DataFrame:
    return monitor.rolling_feed(f.feed_records())


def _count(condition: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END), 0) AS BIGINT)"


@query(build(f"""
SELECT count(*) AS totalProcessed, {_count("decision = 'FRAUD'")} AS fraudCount, {_count("decision = 'REVIEW'")} AS reviewCount,
  {_count("decision = 'APPROVED'")} AS approvedCount, {_count("ragCases > 0")} AS ragHitCount,
  CAST(printf('%.1f', {_count("decision = 'FRAUD'")} / greatest(count(*), 1) * 100) AS DOUBLE) AS fraudRatePct,
  CAST(printf('%.1f', {_count("ragCases > 0")} / greatest(count(*), 1) * 100) AS DOUBLE) AS ragHitRatePct FROM feed""", "feed"))
def headline_metrics(f: Frames) -> DataFrame:
    return monitor.headline_metrics(f.feed_records())


@query(build(f"""
SELECT {_count("ragCases = 0")} AS coldCount, CAST(printf('%.1f', avg(confidencePct) FILTER (ragCases = 0)) AS DOUBLE) AS coldAvgConfidence,
  {_count("ragCases > 0")} AS contextCount, CAST(printf('%.1f', avg(confidencePct) FILTER (ragCases > 0)) AS DOUBLE) AS contextAvgConfidence,
  CAST(printf('%.1f', avg(topSimilarityPct) FILTER (ragCases > 0)) AS DOUBLE) AS contextAvgSimilarity,
  CAST(printf('%.1f', avg(ragCases) FILTER (ragCases > 0)) AS DOUBLE) AS contextAvgCases,
  CAST(printf('%.1f', {_count("ragCases > 0")} * {D(100.0)} / count(*)) AS DOUBLE) AS coveragePct,
  CAST(printf('%.1f', avg(confidencePct) FILTER (ragCases > 0) - avg(confidencePct) FILTER (ragCases = 0)) AS DOUBLE) AS confidenceDelta,
  (SELECT topPattern FROM feed WHERE ragCases > 0 AND topPattern <> '—' GROUP BY topPattern
   ORDER BY count(*) DESC, topPattern DESC LIMIT 1) AS topPattern FROM feed""", "feed"))
def context_impact(f: Frames) -> DataFrame:
    return monitor.context_impact(f.feed_records())
