"""Steps whose cost must not grow faster than their input."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.llm import copies
from riskloom.operators import attribution, cells, similarity, stats
from riskloom.plans import model_queries
from riskloom.plans.frames import Frames
from riskloom.settings import Retrieval
from riskloom.sources import messages
from tests.fixtures import message


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_message_is_parsed_once(spark):
    sent = [message(1, "CUST-001", "2026-07-04T13:00:00"), message(2, "CUST-002", "2026-07-04T13:00:00", currency=None), '{"cut', None]
    valid, quarantine = messages.decode_transactions(spark.createDataFrame([(m,) for m in sent], "value string"))
    assert [r["transactionId"] for r in valid.collect()] == ["T-001"]
    assert sorted(",".join(r["reasons"]) for r in quarantine.collect()) == ["currency_missing", "malformed", "malformed"]
    for side in (valid, quarantine):
        assert plan_of(side).count("from_json") == 1


def test_a_product_is_held_in_small_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    # Few different values, so that many similarities tie.
    stored, asked = (np.sign(rng.normal(size=(n, 6))) * rng.integers(1, 3, (n, 1)) for n in (9_000, 300))
    shapes, best = [], similarity._top

    def top(keys, scores, ids, fetch):
        shapes.append(scores.size)
        return best(keys, scores, ids, fetch)

    monkeypatch.setattr(similarity, "_top", top)
    found = similarity._best_of_block(21)(
        pd.DataFrame({"queryKey": range(300), "vector": list(asked)}), pd.DataFrame({"caseId": range(9_000), "vector": list(stored)}))
    assert max(shapes) <= 1_000_000
    score = np.round(similarity._unit_rows(asked) @ similarity._unit_rows(stored).T, 9)
    for key, rows in found.groupby("queryKey"):
        assert rows["caseId"].tolist() == np.lexsort((np.arange(9_000), -score[key]))[:21].tolist()


def test_cases_of_one_vector_are_compared_once(spark):
    rng = np.random.default_rng(6)
    values = np.sign(rng.normal(size=(40, 4))).astype(float)
    cases = [(f"C{i:03d}", f"CUST-{i % 3}", values[i % 40].tolist()) for i in range(400)]
    queries = [(f"C{i:03d}" if i % 2 else f"Q{i:03d}", f"CUST-{i % 4}", rng.normal(size=4).round(1).tolist()) for i in range(60)]
    queries += queries[:5]
    stored = spark.createDataFrame(cases, "caseId string, customerId string, vector array<double>")
    asked = spark.createDataFrame(queries, "queryId string, customerId string, vector array<double>")
    best = similarity.top_candidates(asked.select(F.col("queryId").alias("queryKey"), "vector").distinct(), stored, 21, block_rows=7)
    got = {}
    for r in best.orderBy("queryKey", "candidateRank").collect():
        got.setdefault(r["queryKey"], []).append(r["caseId"])
    vectors = np.array([c[2] for c in cases])
    for key, _, vector in queries:
        score = np.round(similarity._unit_rows([vector])[0] @ similarity._unit_rows(vectors).T, 9)
        assert got[key] == [cases[k][0] for k in np.lexsort((np.arange(400), -score))[:21]]
    # At most 16 different vectors reach the product.
    plan = similarity.top_candidates(asked.select(F.col("queryId").alias("queryKey"), "vector"), stored, 21)
    assert "ids" in plan_of(plan)
    found = similarity.similar_cases(asked, stored, Retrieval(threshold=-1.0)).collect()
    times = {q[0]: sum(q[0] == o[0] for o in queries) for q in queries}
    for key, customer, vector in queries:
        score = similarity._unit_rows([vector])[0] @ similarity._unit_rows(vectors).T
        order = [k for k in np.lexsort((np.arange(400), -np.round(score, 9))) if cases[k][0] != key]
        order = [k for k in order[:21] for _ in range(times[key])][:20]
        order.sort(key=lambda k: (cases[k][1] != customer, -np.round(score[k], 9), k))
        want = [(cases[k][0], n + 1) for n, k in enumerate(order[:3])]
        assert sorted((r["caseId"], r["rank"]) for r in found if r["queryId"] == key) == sorted(want)


def test_near_copies_come_through_fingerprints(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[200:]), "quite another text of a few words", None]
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    asked, pairs = [], copies.simhash.links
    monkeypatch.setattr(copies.simhash, "links", lambda nodes, *a: asked.append(nodes.count()) or pairs(nodes, *a))
    assert sorted(tuple(r) for r in copies.near_copies(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert asked and asked[0] >= 4


def test_visits_return_only_cases_that_can_be_among_the_best():
    rng = np.random.default_rng(8)
    stored, asked = rng.normal(size=(500, 5)), rng.normal(size=(20, 5))
    score = similarity._unit_rows(asked) @ similarity._unit_rows(stored).T
    floors = [None if k % 5 == 0 else np.sort(score[k])[-4] for k in range(20)]
    found = cells._best_above(6)(
        pd.DataFrame({"queryKey": range(20), "vector": list(asked), "floor": np.array(floors, float)}),
        pd.DataFrame({"caseId": range(500), "vector": list(stored)}))
    assert found.groupby("queryKey").size().tolist() == [6 if k % 5 == 0 else 4 for k in range(20)]
    for key, rows in found.groupby("queryKey"):
        assert rows["caseId"].tolist() == np.argsort(-score[key])[:len(rows)].tolist()


def test_running_auc_folds_its_rows_once(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("step"), (F.col("id") % 11 / 11).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    df = df.union(spark.createDataFrame([(3, 0.5, None), (9, 0.5, None)], df.schema))
    found = stats.running_auc(df, "score", "label", "step")
    plan = [re.sub(r"#\d+L?", "", line).strip(" :+-") for line in plan_of(found).splitlines()]
    steps = [line for line in plan if line.startswith("Aggregate [step], [step AS _step")]
    # Steps without their sums would be counted from rows folded once more.
    assert len(steps) > 1 and all("sum(pos)" in line for line in steps)
    rows = df.where("label is not null").collect()
    for r in found.collect():
        seen = [x for x in rows if x["step"] <= r["step"]]
        wins = [(p["score"] > n["score"]) + 0.5 * (p["score"] == n["score"]) for p in seen if p["label"] for n in seen if not n["label"]]
        assert abs(r["auc"] - sum(wins) / len(wins)) < 1e-12


def test_a_text_travels_once_to_each_pair(spark, monkeypatch):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), *(" ".join(words[:-k]) for k in range(1, 8)), *(" ".join(words[k:]) for k in (30, 50)), "x y z", " ".join(words[:-2])]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    sets = copies.kept(docs.distinct().select(F.col("doc_id").alias("set"), F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("first")))
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 12)] + [(0, 2), (4, 5), (10, 11)], "u long, v long")
    sent, run = [], copies.map_rows
    monkeypatch.setattr(copies, "SHARE", 3)
    monkeypatch.setattr(copies, "map_rows", lambda df, *a, **k: sent.append(df) or run(df, *a, **k))
    near = {tuple(r) for r in copies._verified(pairs, sets, copies._each_once(docs, docs.select("doc_id", F.xxhash64("text").alias("mark"))), 5).collect()}
    shingles = [{tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    asked = {(0, k) for k in range(1, 12)} | {(4, 5), (10, 11)}
    assert near == {(a, b) for a, b in asked if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])}
    assert [c for c, kind in sent[0].dtypes if kind == "string"] == ["text"]


def test_only_rows_a_tree_tells_apart_are_explained(monkeypatch):
    inf = float("inf")
    paths = [
        attribution.Path(1.0, (0,), (-inf,), (0.5,), (0.25,), 0), attribution.Path(2.0, (0, 1), (0.5, -inf), (inf, 3.0), (0.75, 0.5), 0),
        attribution.Path(-1.0, (0, 1), (0.5, 3.0), (inf, inf), (0.75, 0.5), 0),
        attribution.Path(0.5, (1,), (-inf,), (7.0,), (0.5,), 1), attribution.Path(4.0, (1,), (7.0,), (inf,), (0.5,), 1)]
    looked, of_tree = [], attribution.Explainer._of_tree
    monkeypatch.setattr(attribution.Explainer, "_of_tree", staticmethod(lambda tables, x: looked.append(len(x)) or of_tree(tables, x)))
    x = np.random.default_rng(2).choice([-1.0, 0.5, 0.6, 3.0, 5.0, 7.0, 9.0, np.nan, np.inf], size=(500, 3))
    explainer = attribution.Explainer(paths)
    found = explainer.contributions(x)
    # The first tree sends rows three thresholds apart four ways at most, the second two.
    assert looked == [4, 2]
    margin = np.where(x[:, 0] <= 0.5, 1.0, np.where(x[:, 1] <= 3.0, 2.0, -1.0)) + np.where(x[:, 1] <= 7.0, 0.5, 4.0)
    assert np.allclose(found.sum(axis=1) + explainer.base, margin) and not found[:, 2].any()
    one = attribution.Explainer([p for p in paths if p.tree == 0])
    monkeypatch.setattr(one, "_kinds", lambda tree, below, rows: (np.arange(rows), np.arange(rows)))
    other = attribution.Explainer([p for p in paths if p.tree == 1])
    assert np.allclose(found, one.contributions(x) + other.contributions(x))


def test_the_split_for_training_reads_written_rows(spark, small, monkeypatch):
    seen, split = [], model_queries.ml.stratified_split
    monkeypatch.setattr(model_queries.ml, "stratified_split", lambda df, *a: seen.append(df) or split(df, *a))
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    rows = model_queries._training(Frames(spark, small))
    # Decisions need windows and joins, and the split reads its rows three times.
    assert "Window" not in plan_of(seen[0]) and "Join" not in plan_of(seen[0])
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    decided = Frames(spark, small).decided()
    assert rows.count() == decided.count()
    told = decided.select("transactionId", F.col("isFraudulent").cast("int").alias("label"))
    assert rows.select("transactionId", "label").exceptAll(told).isEmpty()


def test_many_rows_make_larger_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(260, 4))
    rows, asked = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], f"{key} long, vector array<double>") for key in ("caseId", "queryKey"))
    count = [spark.range(1).select(similarity._parts(df, 10).alias("n")).first()["n"] for df in (rows, rows.limit(75), rows.limit(0))]
    assert count == [16, 8, 1]
    monkeypatch.setattr(similarity, "PART_VALUES", 50)
    assert spark.range(1).select(similarity._parts(rows, 10).alias("n")).first()["n"] == 21
    monkeypatch.setattr(similarity, "SMALL_PARTS", 2)
    monkeypatch.setattr(similarity, "PART_VALUES", 400)
    got = {}
    for r in similarity.top_candidates(asked, rows, 5, block_rows=10, chunk_rows=10).orderBy("queryKey", "candidateRank").collect():
        got.setdefault(r["queryKey"], []).append(r["caseId"])
    score = np.round(similarity._unit_rows(vectors) @ similarity._unit_rows(vectors).T, 9)
    assert got == {k: np.lexsort((np.arange(260), -score[k]))[:5].tolist() for k in range(260)}


def test_contexts_join_transactions_before_they_are_decided_on(spark, small):
    plan = plan_of(Frames(spark, small).audit_decisions()).splitlines()
    decided = next(k for k, line in enumerate(plan) if "Generate inline(array(struct(finalRiskScore" in line)
    joined = next(k for k, line in enumerate(plan) if "Join LeftOuter" in line and "substring(transactionId" in line)
    assert decided < joined  # rows above a line are made of those below it
    assert "FlatMapCoGroups" not in plan_of(Frames(spark, small).investigated().select("transactionId", "route"))
