import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import features as feat
from riskloom.functions import prompts, text as tx
from riskloom.operators import enrich, panel
from tests.fixtures import CLEAR, EXPECTED, FRAUD, UNKNOWN, enriched


def test_features_of_fixtures(spark):
    rows = feat.with_features(enriched(spark)).select("transactionId", *S.FEATURES).collect()
    for row in rows:
        assert [row[f] for f in S.FEATURES] == pytest.approx(EXPECTED[row["transactionId"]])


@pytest.mark.parametrize("count,feature,high", [(None, 1, 0), (0, 1, 0), (2, 2, 0), (3, 3, 1), (4, 4, 1)])
def test_velocity_boundaries(spark, count, feature, high):
    row = feat.with_features(enriched(spark, [(*CLEAR[:-1], count)])).first()
    assert (row["velocity_count"], row["is_high_velocity"]) == (feature, high)


@pytest.mark.parametrize("hour,off", [(5, 1), (6, 0), (21, 0), (22, 1)])
def test_off_hours(spark, hour, off):
    at = dt.datetime(2026, 7, 6, hour, 59)
    row = feat.with_features(enriched(spark, [(*CLEAR[:7], at, *CLEAR[8:])])).first()
    assert (row["is_off_hours"], row["is_weekend"]) == (off, 0)


@pytest.mark.parametrize("amount,flag", [(534.0, 0), (534.01, 1)])
def test_amount_unusual_is_strict(spark, amount, flag):
    row = feat.with_features(enriched(spark, [(*CLEAR[:2], amount, *CLEAR[3:])])).first()
    assert row["is_amount_unusual"] == flag


def test_zero_average_and_limit(spark):
    profile = ("CUST-002", 0.0, 0.0, [], "Houston", "LOW")
    row = feat.with_features(enriched(spark, [(*CLEAR[:9], profile, 1)])).first()
    assert (row["amount_ratio"], row["daily_limit_ratio"]) == (1.0, 0.0)


def test_empty_location_is_primary_without_profile(spark):
    row = feat.with_features(enriched(spark, [(*UNKNOWN[:6], "", *UNKNOWN[7:])])).first()
    assert row["is_primary_location"] == 1


def test_fixed_text_rounds_the_binary_value(spark):
    values = [0.125, 0.135, 1.005, 2.675, 0.0, 1234567.895, 0.5, 99.995, 2.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(tx.fixed(F.col("v"), 2)).collect()]
    assert got == [f"{v:.2f}" for v in values]
    assert [r[0] for r in df.select(tx.fixed(F.col("v"), 0)).collect()] == [f"{v:.0f}" for v in values]
    assert [r[0] for r in df.select(tx.plain(F.col("v"))).collect()] == [str(v) for v in values]


def test_nested_record_round_trip(spark):
    df = enriched(spark)
    back = enrich.from_record(df.select(enrich.enriched_record().alias("r")).select("r.*"))
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_feature_map_round_trip(spark):
    featured = feat.with_features(enriched(spark))
    wire = featured.select("transactionId", feat.feature_map().alias("featuresUsed"))
    back = feat.from_feature_map(wire).select("transactionId", *S.FEATURES)
    want = featured.select("transactionId", *S.FEATURES)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_context_text(spark):
    df = enriched(spark, [FRAUD, UNKNOWN, (*UNKNOWN[:-1], 1)]).withColumn("s", F.lit(0.7))
    got = [r[0] for r in df.select(tx.context_text()).collect()]
    assert got[0].split("\n") == ["HIGH VELOCITY: 15 transactions in the last 5 minutes",
                                  "Customer baseline: $244.00 avg, HIGH risk."]
    assert got[2] == tx.NO_CONTEXT
    scored = df.select(tx.context_text(F.col("s"))).collect()[2][0]
    assert scored == "ML MODEL PRE-SCREEN: XGBoost fraud score = 70.0%. ML strongly indicates fraud."


def test_case_block_is_empty_without_cases(spark):
    kind = ("array<struct<rank:int,similarity:double,text:string,fraudPattern:string,confidence:double,"
            "confirmedBy:string,embeddedAt:string,transactionId:string>>")
    df = spark.createDataFrame([([],), ([(1, 0.8167, "a\nb", "card_testing", 0.9, "system", "2024-01-02T03:04:05",
                                          "TXN-1234567890")],)], f"cases {kind}")
    empty, full = [r[0] for r in df.select(tx.case_block(F.col("cases"))).collect()]
    assert empty == ""
    assert full.split("\n")[2:5] == [
        "Case 1 (similarity: 81%, pattern: card_testing, confidence: 0.90, txn: ...34567890, confirmed: 2024-01-02, by: system):",
        "  a", "  b"]


@pytest.mark.parametrize("response,want", [
    ("RISK_SCORE: 1.7\nPATTERN: other", (1.0, "", "", "unknown")),
    ("nothing here", (0.5, "", "", "unknown")),
    ("RISK_SCORE: 0.9\nREASONING: bot burst\nRECOMMENDATION: FRAUD_ALERT\nPATTERN: card_testing",
     (0.9, "bot burst", "FRAUD_ALERT", "card_testing")),
    ("risk_score: 0.25 reasoning: ok RECOMMENDATION: APPROVE", (0.25, "ok", "APPROVE", "unknown")),
    (None, (0.5, "", "", "unknown")),
])
def test_parse_agent_text(spark, response, want):
    df = spark.createDataFrame([(response,)], "response string")
    row = prompts.parse_agent_text(df).first()
    assert (row["riskScore"], row["reasoning"], row["recommendation"], row["pattern"]) == want


def test_prompts_name_cases_only_when_present(spark):
    df = enriched(spark, [FRAUD]).withColumn("context", F.lit("nothing"))
    plain = prompts.agent_prompts(df).collect()
    assert {r["agentName"] for r in plain} == {a.name for a in panel.AGENTS}
    assert not any("Where a confirmed case above" in r["prompt"] for r in plain)
    told = prompts.agent_prompts(df.withColumn("context", F.lit(tx.CASE_HEADER))).collect()
    assert all("Where a confirmed case above" in r["prompt"] for r in told)


def test_follow_up_prompt_counts(spark):
    paneled = panel.with_panel(feat.with_features(enriched(spark))).withColumn("context", F.lit("c"))
    counts = {r["transactionId"]: r["count"] for r in prompts.follow_up_prompts(paneled).groupBy("transactionId").count().collect()}
    assert counts == {"TEST-001": 5, "TEST-002": 3, "TEST-003": 3}


def test_rounding_matches_exact_binary_value(spark):
    from riskloom.functions.numbers import rounded, rounded_sql

    values = [n / 1000 for n in range(0, 20000, 5)] + [n / 100000 for n in range(1, 3000)] + [n / 100 for n in range(5, 9000, 10)]
    values += [0.0, 12.25, 12.35, 5e-05, 0.05, 0.005, 1e9 + 0.05]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(rounded(F.col("v"), 2), F.expr(rounded_sql("v", 4)), rounded(F.col("v"), 1)).collect()
    assert [tuple(r) for r in got] == [(round(v, 2), round(v, 4), round(v, 1)) for v in values]
