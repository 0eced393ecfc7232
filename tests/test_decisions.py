import pytest
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import features as feat
from riskloom.functions import text as tx
from riskloom.operators import feedback, monitor, panel, routing
from riskloom.operators.enrich import flatten_enriched
from tests.fixtures import enriched


@pytest.fixture(scope="module")
def paneled(spark):
    return panel.with_panel(feat.with_features(enriched(spark)))


def test_verdicts_of_fixtures(paneled):
    rows = {r["transactionId"]: r for r in panel.decide(paneled).collect()}
    fraud, clear, bare = rows["TEST-001"], rows["TEST-002"], rows["TEST-003"]
    assert fraud["isFraudulent"] and fraud["confidenceScore"] >= 0.7 and fraud["fraudPattern"] == "card_testing"
    assert not clear["isFraudulent"]
    assert 0 <= bare["confidenceScore"] <= 1
    assert (fraud["agentCount"], clear["agentCount"], bare["agentCount"]) == (10, 8, 8)
    assert fraud["streamingBonus"] == pytest.approx(0.35)
    assert clear["streamingBonus"] == 0.0
    assert bare["streamingBonus"] == pytest.approx(0.45)


def test_every_agent_sees_the_attack(spark):
    featured = feat.with_features(enriched(spark)).where("transactionId = 'TEST-001'").withColumn("is_amount_unusual", F.lit(1))
    row = panel.decide(panel.with_panel(featured)).first()
    assert all(row[a.column] >= 0.6 for a in panel.AGENTS)
    assert row["streamingBonus"] == pytest.approx(0.55)


def test_insights_match_counts_and_ranges(paneled):
    rows = panel.long_insights(paneled).collect()
    per_id = {}
    for r in rows:
        assert 0 <= r["riskScore"] <= 1
        per_id[r["transactionId"]] = per_id.get(r["transactionId"], 0) + 1
    assert per_id == {"TEST-001": 10, "TEST-002": 8, "TEST-003": 8}


def test_long_and_wide_forms_agree(paneled):
    keys = ["transactionId", "isFraudulent", "confidenceScore", "fraudPattern", "agentCount", "hasDisagreement"]
    wide = panel.decide(paneled).select(*keys)
    long = panel.decide_long(panel.long_insights(paneled), flatten_enriched(paneled)).select(*keys)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, long.collect()))


def test_no_insights_gives_defaults(spark, paneled):
    none = panel.long_insights(paneled).where(F.lit(False))
    row = panel.decide_long(none, flatten_enriched(paneled)).where("transactionId = 'TEST-002'").first()
    assert (row["baseRisk"], row["confidenceScore"], row["fraudPattern"], row["hasDisagreement"]) == (0.5, 0.3, "unknown", False)


def test_missing_consensus_falls_back_to_agreement(paneled):
    first = panel.long_insights(paneled).where("round = 'first' AND transactionId = 'TEST-001'")
    row = panel.decide_long(first, flatten_enriched(paneled)).where("transactionId = 'TEST-001'").first()
    assert row["isFraudulent"] and row["confidenceScore"] == 0.9 and row["fraudPattern"] == "unknown"


@pytest.mark.parametrize("spread,flag", [(0.40, False), (0.41, True)])
def test_disagreement_boundary(spark, paneled, spread, flag):
    moved = paneled.withColumns({a.column: F.lit(0.3) for a in panel.AGENTS}).withColumn("temporal_risk", F.lit(round(0.3 + spread, 2)))
    assert moved.select(panel.disagreement().alias("d")).first()["d"] is flag


@pytest.mark.parametrize("share,tier", [(0.8, 0.9), (0.6, 0.7), (0.4, 0.5), (0.39, 0.3), (None, 0.3)])
def test_agreement_tiers(spark, share, tier):
    df = spark.createDataFrame([(share,)], "s double")
    assert df.select(panel.agreement_tier(F.col("s"))).first()[0] == tier


@pytest.mark.parametrize("fraud,confidence,name", [
    (True, .81, "fraud-alerts"), (True, .80, "human-review"), (False, .50, "human-review"), (False, .31, "human-review"),
    (False, .30, "approved-transactions"), (False, .70, "approved-transactions"), (False, .90, "approved-transactions")])
def test_route_boundaries(spark, fraud, confidence, name):
    df = spark.createDataFrame([(fraud, confidence)], "isFraudulent boolean, confidenceScore double")
    assert routing.with_route(df).first()["route"] == name


@pytest.mark.parametrize("fraud,confidence,name", [(True, .80, "FRAUD"), (True, .79, "REVIEW"), (False, .50, "APPROVED")])
def test_feed_buckets(spark, fraud, confidence, name):
    df = spark.createDataFrame([(fraud, confidence)], "predictedFraud boolean, confidence double")
    assert df.select(monitor.feed_bucket()).first()[0] == name


@pytest.mark.parametrize("risk,code", [(.80, "FRAUD_ALERT"), (.60, "HUMAN_REVIEW"), (.59, "APPROVE")])
def test_recommendation(spark, risk, code):
    assert spark.createDataFrame([(risk,)], "r double").select(panel.recommendation(F.col("r"))).first()[0] == code


@pytest.mark.parametrize("actual,predicted,confidence,kept", [
    (True, False, 0.0, True), (False, True, 1.0, False), (None, True, .70, True), (None, True, .6999, False), (None, False, 1.0, False)])
def test_should_embed(spark, actual, predicted, confidence, kept):
    df = spark.createDataFrame([(actual, predicted, confidence)], "actualFraud boolean, predictedFraud boolean, confidence double")
    assert df.select(feedback.should_embed()).first()[0] is kept


@pytest.mark.parametrize("velocity,score,kept", [(2, .09, False), (2, .10, True), (3, .0, True)])
def test_cold_start(spark, velocity, score, kept):
    df = spark.createDataFrame([(velocity, score)], "v long, s double")
    assert df.select(feedback.not_cold_start(F.col("v"), F.col("s"))).first()[0] is kept


@pytest.mark.parametrize("confidence,level", [(.80, "HIGH"), (.60, "MEDIUM"), (.59, "LOW")])
def test_review_level(spark, confidence, level):
    df = spark.createDataFrame([(confidence,)], "confidence double")
    assert df.select(feedback.confidence_level()).first()[0] == level


def test_display_pattern(spark):
    df = spark.createDataFrame([("x", 0, None), ("unknown", 2, "card_testing"), ("", 0, "card_testing"), (None, 1, "y")],
                               "fraudPattern string, casesFound int, topCasePattern string")
    assert [r[0] for r in df.select(monitor.display_pattern()).collect()] == ["x", "card_testing", tx.DASH, "y"]


def test_split_is_disjoint_and_complete(paneled):
    parts = routing.split(panel.decide(paneled))
    assert list(parts) == S.ROUTES
    assert sum(p.count() for p in parts.values()) == 3


def test_empty_feed_metrics(spark):
    empty = spark.createDataFrame([], "decision string, ragCases int, topPattern string, confidencePct double, topSimilarityPct double")
    row = monitor.headline_metrics(empty).first()
    assert (row["totalProcessed"], row["fraudRatePct"], row["ragHitRatePct"]) == (0, 0.0, 0.0)
    assert monitor.context_impact(empty).first()["topPattern"] is None


def test_own_routes_are_complete_and_disjoint(paneled):
    decided = panel.decide(paneled)
    parts = routing.split(decided, {"held": F.col("isFraudulent"), "watched": F.col("confidenceScore") > 2}, "passed")
    assert list(parts) == ["held", "watched", "passed"]
    ids = {name: {r["transactionId"] for r in part.collect()} for name, part in parts.items()}
    assert "TEST-001" in ids["held"] and "TEST-002" in ids["passed"] and not ids["watched"]
    assert sum(map(len, ids.values())) == decided.count()


def test_feedback_without_a_prediction_reads_as_even(spark):
    predictions = spark.createDataFrame([("T1", 0.9), ("T9", 0.1)], "transactionId string, mlFraudScore double")
    given = spark.createDataFrame(
        [("T1", 0.8, 6, "AUTO_SYSTEM", None, True), ("T2", None, None, "ANALYST", True, None)],
        "transactionId string, confidence double, agentConsensus int, source string, actualFraud boolean, predictedFraud boolean")
    inputs = feedback.feedback_features()
    rows = feedback.resolve_label(feedback.with_prediction_score(given, predictions)).select(
        "transactionId", "label", *[c.alias(n) for n, c in inputs.items()]).orderBy("transactionId").collect()
    assert [tuple(r) for r in rows] == [("T1", 1, 0.8, 6.0, 0.9, 1.0), ("T2", 1, 0.5, 0.0, 0.5, 0.0)]
