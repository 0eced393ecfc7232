"""The drift-adaptive ensemble: mergeable sums, splits, drift, recovery."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import online
from riskloom.operators.online import OnlineModel, Tree, Window

KIND = "transactionId string, label int, confidence double, agent_consensus double, ml_fraud_score double, source_auto double, step int"


@pytest.fixture(scope="module")
def replayed(spark):
    """Twelve steps of 400 rows; from step 6 on the labels are the other way round."""
    rng = np.random.default_rng(11)
    rows = []
    for step in range(12):
        for k in range(400):
            score, confidence = rng.random(), rng.random()
            said = (score > 0.55) ^ (rng.random() < 0.03) ^ (step >= 6)
            rows.append((f"T{step}-{k}", int(said), float(confidence), float(rng.integers(0, 6)), float(score), float(rng.integers(0, 2)), step))
    return spark.createDataFrame(rows, KIND).cache()


def accuracy(rows):
    return np.mean([(r.onlineScore >= 0.5) == (r.label == 1) for r in rows])


def test_recovers_after_the_labels_flip(replayed):
    scores, models = {}, {}

    def write(scored, number):
        scores[number] = accuracy(scored.collect())

    model = online.learn_in_steps(replayed, "step", list(range(6)), write)
    models["old"] = model
    after = online.learn_in_steps(replayed, "step", list(range(6, 12)), lambda df, k: write(df, 6 + k), model)
    assert scores[5] > 0.9 and scores[6] < 0.2 and scores[11] > 0.9
    assert after.replaced >= 5 and after.updates == 4800 and model.updates == 2400 and model.replaced == 0
    last = replayed.where("step = 11")
    assert accuracy(last.withColumn("onlineScore", models["old"].probability()).collect()) < 0.2


def test_sums_of_two_batches_and_of_one_agree(replayed):
    model = online.learn_in_steps(replayed, "step", [0, 1, 2], lambda df, k: None)
    both = replayed.where("step in (3, 4)")
    total = lambda df: sorted(tuple(r) for r in df.groupBy(*df.columns[:-1]).agg(F.sum("n").alias("n")).collect())
    one = total(model.sums(both))
    two = total(model.sums(both.where("step = 3")).union(model.sums(both.where("step = 4"))))
    assert one == two == total(model.sums(both.repartition(7)))
    assert sum(n for *_, kind, leaf, f, b, y, n in [(r[0], *r[1:]) for r in one] if kind == "error" and y == 0) == 10 * 800
    assert model.learned(model.sums(both).collect()).dump() == model.learned(model.sums(both.repartition(3)).collect()).dump()


def test_members_differ_and_copies_are_poisson():
    model = OnlineModel()
    assert len({tuple(t.features) for t in model.trees}) > 1
    keys = np.arange(200_000).view(np.uint64)
    drawn = [online.copies(keys, member, 42) for member in (0, 1)]
    for d in drawn:
        assert abs(d.mean() - 6) < 0.05 and abs(d.var() - 6) < 0.1 and d.max() > 14
    assert abs(np.corrcoef(drawn)[0, 1]) < 0.01
    assert online.poisson_cuts()[-1] >= 1 - 2.0**-53 and len(online.poisson_cuts()) > 20


def test_gains_equal_brute_force():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 9, (2, online.BINS, 2)).astype(float)
    def entropy(c):
        p = c / c.sum()
        return -sum(x * np.log2(x) for x in p if x > 0)
    for f in range(2):
        whole = table[f].sum(axis=0)
        for edge in range(online.BINS - 1):
            a, b = table[f, :edge + 1].sum(axis=0), table[f, edge + 1:].sum(axis=0)
            want = entropy(whole) - (a.sum() * entropy(a) + b.sum() * entropy(b)) / whole.sum() if a.sum() and b.sum() else 0
            assert online._gains(table)[f, edge] == pytest.approx(want)


def test_splits_only_where_the_bound_allows():
    alike = np.zeros((3, online.BINS, 2))
    alike[:, 3] = alike[:, 20] = [30, 30]
    tree = Tree([0, 1, 2])
    tree.add(0, alike)
    assert tree.feature == [-1]  # nothing to gain
    told = alike.copy()
    told[1, 3], told[1, 20] = [600, 0], [0, 600]
    told[0, 3], told[2, 3] = [600, 600], [600, 600]
    told[0, 20] = told[2, 20] = 0
    tree = Tree([0, 1, 3])
    tree.add(0, told)
    assert tree.feature == [1, -1, -1] and tree.edge[0] in range(3, 20)
    bins = np.array([[0, 3, 0, 0], [0, 20, 0, 0]])
    assert tree.leaf(bins).tolist() == [1, 2] and tree.probability()[2] > 0.99 > 0.01 > tree.probability()[1]


def test_window_is_cut_at_drift_only():
    rng = np.random.default_rng(3)
    window = Window()
    assert not any(window.add(100, rng.binomial(100, 0.1)) for _ in range(200))
    assert sum(b[0] for b in window.buckets) == 20_000 and len(window.buckets) <= 5 * 12
    assert any(window.add(100, rng.binomial(100, 0.3)) for _ in range(10))
    assert sum(b[0] for b in window.buckets) <= 1_500
    assert not Window().add(0, 0)
    better = Window()
    for rate in [0.5] * 20 + [0.05] * 20:
        assert not better.add(100, rng.binomial(100, rate))  # improvement is no alarm


def test_missing_inputs_and_empty_batches(spark, replayed):
    odd = spark.createDataFrame([("a", 1, None, None, float("nan"), 7.0, 0), (None, 0, -3.0, 1.0, 0.5, 0.0, 0)], KIND)
    model = OnlineModel().learn(odd)
    assert model.updates == 2
    assert all(0 < r.p < 1 for r in odd.select(model.probability().alias("p")).collect())
    same = model.learn(replayed.where("step = 99"))
    assert same.dump() == model.dump()
