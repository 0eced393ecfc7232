import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.operators import attribution, audit, enrich, ml, quality, stats
from riskloom.plans import model_queries, registry
from riskloom.plans.frames import Frames
from riskloom.sources import generators


@pytest.fixture(scope="module")
def training(spark):
    return generators.generate_training_set(spark, 2000).cache()


def test_training_set_shape(training):
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    assert counts == {0: 1600, 1: 400}
    row = training.agg(*[F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in S.FEATURES]).first()
    assert sum(row) == 0
    assert training.where("velocity_squared <> velocity_count * velocity_count").count() == 0
    assert training.where("label = 0 AND (hour < 8 OR hour >= 22)").count() == 0
    attack = training.where("label = 1").agg(F.avg("is_online")).first()[0]
    assert attack == 1.0


def test_generation_repeats_and_changes_with_seed(spark):
    one, two = generators.generate_training_set(spark, 50), generators.generate_training_set(spark, 50)
    assert one.collect() == two.collect()
    assert one.collect() != generators.generate_training_set(spark, 50, seed=7).collect()


@pytest.mark.parametrize("scenario,n,kinds", [
    ("normal", 3, {"TXN": 3}), ("rapid", 15, {"RAPID": 15}), ("unusual", 5, {"UNUSUAL": 5}),
    ("mixed", 21, {"TXN": 10, "RAPID": 8, "UNUSUAL": 3}), ("continuous", 100, None)])
def test_scenarios(spark, scenario, n, kinds):
    profiles = generators.generate_profiles(spark, 5)
    rows = generators.generate_transactions(spark, scenario, profiles, 5).orderBy("timestamp").collect()
    assert len(rows) == n and len({r["transactionId"] for r in rows}) == n
    tally = {}
    for r in rows:
        part = r["transactionId"].split("-")[1]
        tally[part if part in ("RAPID", "UNUSUAL") else "TXN"] = tally.get(part if part in ("RAPID", "UNUSUAL") else "TXN", 0) + 1
    if kinds:
        assert tally == kinds
    if scenario == "rapid":
        assert {r["customerId"] for r in rows} == {"CUST-001"}
        assert all(10 <= r["amount"] <= 59 and r["metadata"]["rapidFire"] for r in rows)
        assert (rows[1]["timestamp"] - rows[0]["timestamp"]).total_seconds() == pytest.approx(0.2)


def test_profiles_in_range(spark):
    row = generators.generate_profiles(spark, 500).agg(
        F.min("averageTransactionAmount"), F.max("averageTransactionAmount"), F.min("dailySpendingLimit"),
        F.max("dailySpendingLimit"), F.countDistinct("primaryLocation"), F.countDistinct("riskLevel")).first()
    assert row[0] >= 50 and row[1] <= 499 and row[2] >= 1000 and row[3] <= 4999 and (row[4], row[5]) == (5, 3)


def test_rate_stream_is_a_stream(spark):
    profiles = generators.generate_profiles(spark, 5)
    assert generators.stream_transactions(spark, profiles, 5).isStreaming


def test_split_is_exact_and_stratified(training):
    parts = ml.stratified_split(training, "label", "id").groupBy("label", "isTest").count().collect()
    assert {(r["label"], r["isTest"]): r["count"] for r in parts} == {
        (0, True): 320, (0, False): 1280, (1, True): 80, (1, False): 320}


def test_scaler_matches_numpy(training):
    scaler = ml.fit_scaler(training)
    values = np.array(training.select(*S.FEATURES).collect(), dtype=float)
    assert list(scaler.means.values()) == pytest.approx(list(values.mean(axis=0)))
    assert list(scaler.deviations.values()) == pytest.approx([d or 1.0 for d in values.std(axis=0)])


def test_train_save_load_score_explain(spark, training, tmp_path):
    rows = ml.stratified_split(training, "label", "id")
    train, test = rows.where(~F.col("isTest")), rows.where(F.col("isTest"))
    assert ml.load_model(str(tmp_path / "none")) is None
    assert ml.score(None, test).count() == 0
    model = ml.train_classifier(train, trees=5, depth=4)
    ml.save_model(model, str(tmp_path / "m"))
    scored = ml.score(ml.load_model(str(tmp_path / "m")), test).cache()
    assert scored.count() == 400
    report = {r["class"]: r for r in stats.binary_metrics(scored, "mlFraudScore", "label").collect()}
    assert report["fraud"]["support"] == 80 and report["fraud"]["auc"] > 0.95 and report["fraud"]["recall"] > 0.8
    top = ml.feature_importance(model, spark).collect()
    assert len(top) == 5 and top[0]["importance"] >= top[4]["importance"]
    explained = attribution.tree_attributions(model, test).cache()
    total = F.aggregate("contributions", F.col("base"), lambda a, c: a + c["value"])
    assert explained.agg(F.max(F.abs(total - F.col("margin")))).first()[0] < 1e-9
    entries = explained.limit(5).select(ml.top_attributions(F.col("contributions")).alias("t")).collect()
    assert all(len(r["t"]) == 3 and abs(r["t"][0]["value"]) >= abs(r["t"][2]["value"]) for r in entries)


def _subset_value(nodes, tree, node, row, known):
    """Margin of a tree with some features known, by recursion over its nodes."""
    here = nodes[tree, node]
    if here["left"] < 0:
        return here["weight"] * here["value"]
    if here["feature"] in known:
        return _subset_value(nodes, tree, here["left"] if row[here["feature"]] <= here["threshold"] else here["right"], row, known)
    left, right = nodes[tree, here["left"]], nodes[tree, here["right"]]
    return sum(c["cover"] * _subset_value(nodes, tree, c["node"], row, known) for c in (left, right)) / (left["cover"] + right["cover"])


def test_tree_contributions_equal_all_subsets(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.3) ^ (x[:, 3] > 1.2)).astype(float)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")
    booster = GBTClassifier(featuresCol="features", labelCol="y", maxIter=4, maxDepth=5, stepSize=0.3, subsamplingRate=0.7, seed=1)
    model = Pipeline(stages=[ml.assembler(names, "features"), booster]).fit(df)
    odd = spark.createDataFrame([(float("nan"), 0.0, 1.0, -1.0, 0.0), (1e9, -1e9, 0.1, 0.2, 0.0)], df.schema)
    rows = attribution.tree_attributions(model, df.limit(12).union(odd), names).collect()
    nodes = {(r["tree"], r["node"]): r for r in attribution.stored_nodes(model).collect()}
    trees = sorted({t for t, _ in nodes})
    repeated = [p for p in attribution.paths(model) if any(np.isfinite(a) and np.isfinite(b) for a, b in zip(p.low, p.high))]
    assert repeated  # one feature split twice on a path
    for row in rows:
        value = {}
        for k in range(16):
            known = {j for j in range(4) if k >> j & 1}
            value[k] = sum(_subset_value(nodes, t, 0, [row[n] for n in names], known) for t in trees)
        for j in range(4):
            want = sum(math.factorial(s.bit_count()) * math.factorial(3 - s.bit_count()) / 24 * (value[s | 1 << j] - value[s])
                       for s in range(16) if not s >> j & 1)
            assert row["contributions"][j]["value"] == pytest.approx(want, abs=1e-10)
        assert row["base"] == pytest.approx(value[0], abs=1e-10) and row["margin"] == pytest.approx(value[15], abs=1e-10)


@pytest.mark.parametrize("steps", [1, 2, 7, 33])
def test_running_auc_equals_pairs(spark, steps):
    rng = np.random.default_rng(steps)
    rows = [(int(rng.integers(0, steps)), round(float(rng.random()), 1) * 3 - 1, int(rng.random() < 0.4)) for _ in range(150)]
    got = {r.step: r for r in stats.running_auc(spark.createDataFrame(rows, "t int, s double, y int"), "s", "y", "t").collect()}
    assert set(got) == {t for t, _, _ in rows}
    for step, found in got.items():
        pos, neg = ([s for t, s, y in rows if t <= step and y == k] for k in (1, 0))
        assert found.updates == len(pos) + len(neg)
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert found.auc == (pytest.approx(wins / (len(pos) * len(neg))) if pos and neg else None)


def test_linear_contributions_add_up(training):
    model = ml.LinearModel({"is_bot_device": 1.3, "amount_ratio": 0.2, "hour": -0.05}, -1.0)
    means = ml.feature_means(training, list(model.coefficients))
    base = -1.0 + sum(w * means[n] for n, w in model.coefficients.items())
    parts = F.aggregate(model.contributions(means), F.lit(base), lambda a, c: a + c["value"])
    gap = training.select(F.abs(F.round(1 / (1 + F.exp(-parts)), 4) - model.probability()).alias("g")).agg(F.max("g")).first()[0]
    assert gap <= 1e-4


def test_encoder_hook(spark):
    import pandas as pd

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    assert ml.embed_text(spark.createDataFrame([("abc",)], "t string"), "t", encoder=encode).first()["embedding"] == [3.0, 1.0]


# --- keyed updates and quality ---------------------------------------------

def test_upsert_versions_and_totals(spark):
    kind = ("customer_id string, avg_transaction_amount decimal(12,2), typical_merchant_category string, account_age_days int, "
            "risk_score decimal(5,2), total_transactions int, total_fraud_cases int, last_transaction_at timestamp_ntz")
    stored = spark.sql("""SELECT 'CUST-SAMPLE-001' customer_id, 125.50BD avg_transaction_amount, 'retail' typical_merchant_category,
        365 account_age_days, 25.0BD risk_score, 42 total_transactions, 0 total_fraud_cases,
        CAST(NULL AS TIMESTAMP_NTZ) last_transaction_at, CAST(NULL AS TIMESTAMP_NTZ) last_updated, 1 version""")
    given = spark.createDataFrame([("CUST-SAMPLE-001", None, None, None, None, None, 3, None), ("NEW", None, None, 1, None, None, None, None)], kind)
    rows = {r["customer_id"]: r for r in audit.upsert_customers(stored, given).collect()}
    old, new = rows["CUST-SAMPLE-001"], rows["NEW"]
    assert (old["version"], old["total_transactions"], old["total_fraud_cases"], old["avg_transaction_amount"]) == (2, 42, 3, 0)
    assert (new["version"], new["total_transactions"], new["total_fraud_cases"]) == (1, 0, 0)


def test_ground_truth_hits_first_row_only(spark):
    rows = [(2, "T", "xgboost", 0.9), (1, "T", "xgboost", 0.2), (3, "T", "river_srp", 0.9), (4, "U", "xgboost", 0.5)]
    predictions = spark.createDataFrame(rows, "id long, transaction_id string, model_type string, prediction_score double").withColumns({
        "actual_label": F.lit(None).cast("boolean"), "prediction_correct": F.lit(None).cast("boolean"), "updated_at": F.lit(None).cast("timestamp")})
    labels = spark.createDataFrame([("T", "xgboost", True), ("U", "xgboost", True)], "transaction_id string, model_type string, actual_label boolean").withColumn(
        "updated_at", F.current_timestamp())
    got = {r["id"]: r["prediction_correct"] for r in audit.apply_ground_truth(predictions, labels).collect()}
    assert got == {1: False, 2: None, 3: None, 4: True}


def test_history_of_one_customer(spark):
    txn = spark.sql("""SELECT concat('T', id) transaction_id, 'C' customer_id, 1D amount, 'M' merchant_id, 'R' merchant_category,
        timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, id, 0) timestamp FROM range(5)""")
    decisions = spark.sql("SELECT id, concat('T', 4 - id % 2) transaction_id, 'BLOCK' decision, 'p' fraud_pattern, 1D llm_confidence, 1D ml_score FROM range(3)")
    rows = audit.transaction_history(txn, decisions, "C", 4).collect()
    assert [r["transaction_id"] for r in rows] == ["T4", "T4", "T3", "T2"]
    with pytest.raises(ValueError):
        audit.recent_decisions(decisions, 0)


def test_quality_rules_find_each_violation(spark):
    df = spark.createDataFrame([("a", 2.0, 1, 1.0, "BLOCK", None), ("b", 0.5, 101, 0.5, "DENY", None), (None, None, 5, None, None, False)],
                               "transaction_id string, ml_score double, llm_confidence int, rag_similarity_score double, decision string, rag_context_used boolean")
    counts = {r["rule"]: r["violations"] for r in quality.violation_counts(df, quality.RULES["fraud_decisions"]).collect()}
    assert counts == {"transaction_id_missing": 1, "ml_score_range": 1, "confidence_range": 1, "similarity_without_context": 0, "decision_value": 1}
    good, bad = quality.quarantine(df, quality.RULES["fraud_decisions"])
    assert (good.count(), bad.count()) == (0, 3)


def test_latest_profiles_last_offset_wins(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 3, "z"), ("A", 2, "y"), ("B", 1, "q")], "customerId string, offset long, v string")
    assert {r["customerId"]: r["v"] for r in enrich.latest_profiles(df).collect()} == {"A": "z", "B": "q"}


def test_tree_queries_share_one_model_of_default_size(spark, small, monkeypatch):
    train, sizes = ml.train_classifier, []

    def fewer(rows, **size):
        sizes.append(size)
        return train(rows, **{"trees": 3, "depth": 3} | size)

    monkeypatch.setattr(ml, "train_classifier", fewer)
    monkeypatch.setattr(model_queries, "_written", {})
    top = registry.QUERIES["feature_importance"](spark, small).collect()
    scored = registry.QUERIES["tree_scores"](spark, small)
    assert sizes == [{}] and len(top) == 5 and scored.columns[:3] == ["transactionId", "label", "mlFraudScore"]
    model_queries.feature_importance(Frames(spark, small), trees=2, depth=2)
    assert sizes == [{}, {"trees": 2, "depth": 2}]
