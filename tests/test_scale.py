"""Groups that are too large for one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators import ordered, similarity, stats, velocity
from riskloom.settings import Retrieval


@pytest.fixture
def composed(monkeypatch):
    """Compose a plan while every action is refused."""
    def compose(build, df):
        def refuse(*_, **__):
            raise AssertionError("a job ran while a plan was composed")

        with monkeypatch.context() as patch:
            for action in ("checkpoint", "collect", "count", "first", "isEmpty"):
                patch.setattr(type(df), action, refuse)
            return build()

    return compose


def _skewed(spark, n=6000):
    """A third of the rows share one key, and time ties abound."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97)
    return spark.range(n).select(key.alias("k"), (F.hash("id") % 50).alias("t"), F.col("id"), (F.col("id") % 7).alias("v"))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("ranged", [False, True])
def test_running_totals_with_hot_groups(spark, composed, keys, ranged):
    df = _skewed(spark)
    ranges = F.floor(F.col("t") / 7) if ranged else None
    got = composed(lambda: ordered.running_totals(
        df, keys, ["t", "id"], {"n": F.lit(1).cast("long"), "s": F.col("v")}, ranges), df)
    frame = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.count(F.lit(1)).over(frame), "s": F.sum("v").over(frame)})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("split", [None, "5 minutes"])
def test_hot_customer_velocity(spark, composed, split):
    txn = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), (F.col("id") % 50).cast("string"))).alias("customerId"),
        (F.lit("2026-07-04 13:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
        F.format_string("T%05d", "id").alias("transactionId"))
    counted = composed(lambda: velocity.velocity_running(txn, "1 hour", split), txn).where("customerId = 'HOT'").select("transactionId", "velocityCount").collect()
    ranked = sorted(counted)
    assert [r["velocityCount"] for r in ranked] == list(range(1, 1001))


def test_auc_and_quantiles_match_brute_force(spark):
    rng = np.random.default_rng(3)
    scores, labels = np.round(rng.random(3000), 3), rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "s double, y int")
    pos, neg = scores[labels == 1], scores[labels == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert stats.auc(df, "s", "y").first()["auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    long = df.select(F.lit("s").alias("feature_name"), F.col("s").alias("value"))
    row = stats.exact_quantiles(long, ["feature_name"], stats.QUANTILES).first()
    for name, q in stats.QUANTILES.items():
        assert row[name] == pytest.approx(np.quantile(scores, q))


def test_blocked_similarity_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    cases = rng.normal(size=(137, 8))
    cases[40:80] = cases[40]  # a third of the store is copies of one case
    queries = rng.normal(size=(61, 8))
    queries[20:45] = queries[20]
    left = spark.createDataFrame([(i, f"C{i % 5}", [float(x) for x in v]) for i, v in enumerate(queries)],
                                 "queryId long, customerId string, vector array<float>")
    right = spark.createDataFrame([(i, f"C{i % 7}", [float(x) for x in v]) for i, v in enumerate(cases)],
                                  "caseId long, customerId string, vector array<float>")
    wanted = Retrieval(keep=3, threshold=0.4)
    got = similarity.similar_cases(left, right, wanted, block_rows=20, chunk_rows=10)
    have = {(r["queryId"], r["rank"]): (r["caseId"], r["similarity"]) for r in got.collect()}

    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)
    sims = unit(queries.astype(np.float32).astype(float)) @ unit(cases.astype(np.float32).astype(float)).T
    expected = {}
    for i in range(len(queries)):
        near = sorted(range(len(cases)), key=lambda j: (-round(sims[i, j], 9), j))[:wanted.fetch]
        near.sort(key=lambda j: (f"C{j % 7}" != f"C{i % 5}", -round(sims[i, j], 9), j))
        for rank, j in enumerate(near[:3], 1):
            if round(sims[i, j], 4) >= 0.4:
                expected[(i, rank)] = (j, round(sims[i, j], 4))
    assert have.keys() == expected.keys()
    assert all(have[k][0] == expected[k][0] for k in have)
    assert all(have[k][1] == pytest.approx(expected[k][1], abs=1e-4) for k in have)


def test_missing_customer_keeps_similarity_order(spark):
    left = spark.createDataFrame([(9, None, [1.0, 0.0])], "queryId long, customerId string, vector array<float>")
    right = spark.createDataFrame([(i, "C", [1.0, i / 10]) for i in range(4)], "caseId long, customerId string, vector array<float>")
    rows = similarity.similar_cases(left, right).orderBy("rank").collect()
    assert [r["caseId"] for r in rows] == [0, 1, 2]


def test_lsh_pairs_are_within_the_distance(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(40, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    left = spark.createDataFrame(rows, "queryId long, vector array<double>")
    right = spark.createDataFrame(rows, "caseId long, vector array<double>")
    found = {(r["queryId"], r["caseId"]) for r in similarity.lsh_candidates(left, right, 0.6).collect()}
    close = {(i, j) for i in range(40) for j in range(40) if np.linalg.norm(points[i] - points[j]) < 0.6}
    assert {(i, i) for i in range(40)} <= found <= close


def test_exact_split_with_hot_classes(spark):
    from riskloom.operators import ml

    rows = spark.range(3000).select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    parts = ml.stratified_split(rows, "label", "id").groupBy("label", "isTest").count().collect()
    assert {(r["label"], r["isTest"]): r["count"] for r in parts} == {(0, True): 480, (0, False): 1920, (1, True): 120, (1, False): 480}


def test_value_ranges_never_fall(spark):
    values = [float("-inf"), -1e300, -7.5, -1.0, -1e-9, 0.0, 1e-9, 0.25, 0.5, 1.0, 3.0, 1e300, float("inf"), float("nan")]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    found = [r["r"] for r in rows.orderBy("k").select(stats.value_ranges(F.col("v")).alias("r")).collect()]
    assert found == sorted(found) and len(set(found)) >= 8
