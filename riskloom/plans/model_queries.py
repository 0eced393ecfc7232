"""Queries on models, metrics, feature statistics and drift."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.operators import attribution, feedback, ml, online, similarity, stats
from riskloom.operators import cases as case_store
from riskloom.functions import text as tx
from riskloom.plans.frames import SCORE_CARD, Frames
from riskloom.plans.oracle import CARD, D, build
from riskloom.plans.registry import query
from riskloom.session import compiled, cut_lineage, shared_folder
from riskloom.settings import Retrieval


@query(build("SELECT transactionId, mlFraudScore FROM sco", "sco"))
def card_scores(f: Frames) -> DataFrame:
    return f.scored().select("transactionId", "mlFraudScore")


_CONTRIB = " UNION ALL ".join(
    f"SELECT transactionId, '{name}' AS feature, {D(w)} * ({name} - (SELECT avg({name}) FROM feat)) AS value FROM feat" for name, w in CARD)


@query(build(f"""
SELECT transactionId, feature, round(value, 6) AS value, CAST("rank" AS INTEGER) AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY transactionId ORDER BY round(abs(value), 9) DESC, feature) AS "rank" FROM ({_CONTRIB}))
WHERE "rank" <= 3""", "feat"))
def top_attributions(f: Frames) -> DataFrame:
    """Three largest contributions to the score, sign kept."""
    featured = f.featured()
    means = ml.feature_means(featured, list(SCORE_CARD.coefficients))
    top = ml.top_attributions(SCORE_CARD.contributions(means))
    rows = featured.select("transactionId", F.posexplode(top).alias("position", "entry"))
    return rows.select("transactionId", "entry.feature", F.round("entry.value", 6).alias("value"),
                       (F.col("position") + 1).alias("rank"))


_SCALED = ", ".join(
    f"round(({n} - (SELECT avg({n}) FROM feat)) / (SELECT coalesce(nullif(stddev_pop({n}), 0), 1) FROM feat), 4) AS {n}" for n in S.FEATURES)


@query(build(f"SELECT transactionId, {_SCALED} FROM feat", "feat"))
def scaled_features(f: Frames) -> DataFrame:
    featured = f.featured()
    scaler = ml.fit_scaler(featured)
    return featured.select("transactionId", *[F.round(c, 4).alias(n) for n, c in scaler.columns().items()])


@query(build("""
SELECT transactionId, label, place <= floor(size * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS isTest FROM (
  SELECT transactionId, isFraudulent AS label, count(*) OVER (PARTITION BY isFraudulent) AS size,
    row_number() OVER (PARTITION BY isFraudulent ORDER BY md5(transactionId || '42'), transactionId) AS place FROM dec)""", "dec"))
def stratified_split(f: Frames) -> DataFrame:
    rows = f.decided().select("transactionId", F.col("isFraudulent").alias("label"))
    return ml.stratified_split(rows, "label", "transactionId")


@query(build("SELECT count(*) AS rows, round(avg(CASE WHEN isFraudulent THEN 1 ELSE 0 END), 6) AS fraud_rate FROM dec", "dec"))
def class_balance(f: Frames) -> DataFrame:
    return stats.class_balance(f.decided(), "isFraudulent").withColumn("fraud_rate", F.round("fraud_rate", 6))


_AUC = """(SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (sum(y) * (count(*) - sum(y)))
  FROM (SELECT y, avg(pos) OVER (PARTITION BY s) AS r FROM (SELECT *, row_number() OVER (ORDER BY s) AS pos FROM {0})))"""
_LABELLED = """lbl AS (SELECT mlFraudScore AS s, CAST(coalesce(actualFraud, predictedFraud) AS INTEGER) AS y, date_trunc('day', feedbackAt) AS step FROM pair)"""


def _with_labelled(sql: str, first: str) -> str:
    return sql.replace(f"\n{first}", f",\n{_LABELLED}\n{first}", 1)


def _share(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({a} + {b}, 0), 0)"


def _class_sql(name: str, hit: str, wrong: str, missed: str) -> str:
    p, r = _share(hit, wrong), _share(hit, missed)
    return f"""SELECT '{name}' AS class, round({p}, 6) AS "precision", round({r}, 6) AS recall,
  round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 6) AS f1, {hit} + {missed} AS support, round({_AUC.format("lbl")}, 6) AS auc FROM conf"""


@query(_with_labelled(build(f"""
SELECT * FROM ({_class_sql('fraud', 'tp', 'fp', 'fn')}) UNION ALL {_class_sql('legitimate', 'tn', 'fn', 'fp')}""", "pair"), "SELECT * FROM")
    .replace("\nSELECT * FROM", """,
conf AS (SELECT count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (s < 0.5 AND y = 1) AS fn, count(*) FILTER (s < 0.5 AND y = 0) AS tn FROM lbl)
SELECT * FROM""", 1))
def binary_metrics(f: Frames) -> DataFrame:
    labelled = feedback.resolve_label(f.paired())
    report = stats.binary_metrics(labelled, "mlFraudScore", "label")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "auc")})


_RUNNING = """
SELECT step, count(*) AS updates, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (sum(y) * (count(*) - sum(y))), 6) AS auc
FROM (SELECT step, y, avg(pos) OVER (PARTITION BY step, s) AS r FROM (
  SELECT d.step, l.s, l.y, row_number() OVER (PARTITION BY d.step ORDER BY l.s) AS pos
  FROM (SELECT DISTINCT step FROM lbl) d JOIN lbl l ON l.step <= d.step)) GROUP BY step"""


def _running_auc(f: Frames, unit: str) -> DataFrame:
    labelled = feedback.resolve_label(f.paired()).withColumn("step", F.date_trunc(unit, "feedbackAt").cast("timestamp_ntz"))
    return stats.running_auc(labelled, "mlFraudScore", "label", "step").withColumn("auc", F.round("auc", 6))


@query(_with_labelled(build(_RUNNING, "pair"), "SELECT step, count"))
def running_auc(f: Frames) -> DataFrame:
    """AUC of everything seen up to each day."""
    return _running_auc(f, "day")


@query(_with_labelled(build(_RUNNING, "pair"), "SELECT step, count").replace("date_trunc('day', feedbackAt)", "date_trunc('hour', feedbackAt)"))
def running_auc_hourly(f: Frames) -> DataFrame:
    """AUC of everything seen up to each hour."""
    return _running_auc(f, "hour")


_LONG = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature_name, date_trunc('day', "timestamp") AS window_start, CAST({n} AS DOUBLE) AS value, "timestamp" AS moment FROM feat"""
    for n in S.FEATURES)
_STATS = {
    "mean": "avg(value)", "stddev": "stddev_samp(value)", "median": "quantile_cont(value, 0.5)",
    "p25": "quantile_cont(value, 0.25)", "p50": "quantile_cont(value, 0.5)", "p75": "quantile_cont(value, 0.75)",
    "p95": "quantile_cont(value, 0.95)", "p99": "quantile_cont(value, 0.99)", "min": "min(value)", "max": "max(value)",
    "null_rate": "avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END)",
}


@query(build(" UNION ALL ".join(
    f"""SELECT feature_name, '{t}' AS stat_type, round({e}, 6) AS stat_value, count(*) AS sample_count, CAST(window_start AS TIMESTAMP) AS window_start,
  CAST(window_start AS TIMESTAMP) + INTERVAL 1 DAY AS window_end FROM ({_LONG}) GROUP BY feature_name, window_start""" for t, e in _STATS.items()), "feat"))
def feature_stats(f: Frames) -> DataFrame:
    return stats.feature_stats(f.featured(), S.FEATURES).withColumn("stat_value", F.round("stat_value", 6))


def _drift_sql() -> str:
    return f"""
SELECT b.feature_name, round(b.m, 4) AS baseline_mean, round(c.m, 4) AS current_mean, round(b.s, 4) AS baseline_std,
  round((c.m - b.m) / nullif(b.s, 0), 4) AS z_shift, round(p.psi, 4) AS psi
FROM (SELECT feature_name, avg(value) AS m, stddev_samp(value) AS s FROM lng WHERE NOT recent GROUP BY feature_name) b
JOIN (SELECT feature_name, avg(value) AS m FROM lng WHERE recent GROUP BY feature_name) c USING (feature_name)
JOIN (SELECT feature_name, sum((a - e) * ln(a / e)) AS psi FROM (
    SELECT feature_name, bin,
      greatest({D(1e-06)}, CAST(count(*) FILTER (NOT recent) AS DOUBLE) / any_value(nb)) AS e,
      greatest({D(1e-06)}, CAST(count(*) FILTER (recent) AS DOUBLE) / any_value(nc)) AS a
    FROM (SELECT l.*, nb, nc, CASE WHEN hi = lo THEN 0 ELSE greatest(0, least(9, floor((value - lo) * 10 / (hi - lo)))) END AS bin
      FROM lng l JOIN (SELECT feature_name, min(value) FILTER (NOT recent) AS lo, max(value) FILTER (NOT recent) AS hi,
        count(*) FILTER (NOT recent) AS nb, count(*) FILTER (recent) AS nc FROM lng GROUP BY feature_name) e USING (feature_name))
    GROUP BY feature_name, bin) GROUP BY feature_name) p USING (feature_name)"""


@query(build(_drift_sql().strip(), "feat").replace(
    "\nSELECT b.feature_name", f""",\nlng AS (SELECT feature_name, value, moment >= TIMESTAMP '2024-01-16' AS recent FROM ({_LONG}))\nSELECT b.feature_name""", 1))
def feature_drift(f: Frames) -> DataFrame:
    """Second half of the month against the first."""
    featured, change = f.featured(), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    drift = stats.feature_drift(featured.where(F.col("timestamp") >= change), featured.where(F.col("timestamp") < change), S.FEATURES)
    return drift.withColumns({c: F.round(c, 4) for c in ("baseline_mean", "current_mean", "baseline_std", "z_shift", "psi")})


# --- queries no plain SQL can answer (rows only, tested against fixtures) -------

def _training(f: Frames) -> DataFrame:
    """Written once: training, baselines and scoring all read it, and the split reads the decisions three times."""
    rows = f.decided().select("transactionId", F.col("isFraudulent").cast("int").alias("label"), *S.FEATURES)
    with compiled(f.spark):
        rows = cut_lineage(rows)
    return cut_lineage(ml.stratified_split(rows, "label", "transactionId"))


_written: dict[tuple, str] = {}


def _trained(f: Frames, **size: int) -> tuple[DataFrame, PipelineModel]:
    """The split rows and the model trained on their larger part.

    A model is trained once per session and content of the rows, and written
    for the queries that share it.
    """
    rows = _training(f)
    content = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    key = (f.spark.sparkContext.applicationId, *content, *sorted(size.items()))
    if key not in _written:
        path = f"{shared_folder(f.spark)}/riskloom-trees-{uuid.uuid4().hex}"
        ml.save_model(ml.train_classifier(rows.where(~F.col("isTest")), **size), path)
        _written[key] = path
    return rows, ml.load_model(_written[key])


@query()
def tree_scores(f: Frames, **size: int) -> DataFrame:
    """Boosted trees trained on the split's larger part, scoring the rest, with attributions.

    ``size`` (trees, depth) is for tests; without it the classifier's defaults hold.
    """
    rows, model = _trained(f, **size)
    scored = ml.score(model, rows.where(F.col("isTest"))).select("transactionId", "label", "mlFraudScore", *S.FEATURES)
    explained = attribution.tree_attributions(model, scored)
    top = ml.top_attributions(F.col("contributions"))
    return explained.select("transactionId", "label", F.round("mlFraudScore", 6).alias("mlFraudScore"),
                            top[0]["feature"].alias("topFeature"), F.round(top[0]["value"], 6).alias("topValue"))


@query(build("""
SELECT transactionId, CAST(label AS INTEGER) AS label, TRUE AS scoreInRange, TRUE AS addsUp, 19 AS features FROM (
  SELECT transactionId, isFraudulent AS label, place <= floor(size * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS isTest FROM (
    SELECT transactionId, isFraudulent, count(*) OVER (PARTITION BY isFraudulent) AS size,
      row_number() OVER (PARTITION BY isFraudulent ORDER BY md5(transactionId || '42'), transactionId) AS place FROM dec)) WHERE isTest""", "dec"))
def tree_attributions(f: Frames, **size: int) -> DataFrame:
    """The test rows: score in range, and contributions that add up to the margin with the base, to 1e-9."""
    rows, model = _trained(f, **size)
    scored = ml.score(model, rows.where(F.col("isTest"))).select("transactionId", "label", "mlFraudScore", *S.FEATURES)
    explained = attribution.tree_attributions(model, scored)
    whole = F.aggregate("contributions", F.col("base"), lambda total, part: total + part["value"])
    return explained.select("transactionId", "label", F.col("mlFraudScore").between(0, 1).alias("scoreInRange"),
                            (F.abs(whole - F.col("margin")) < 1e-9).alias("addsUp"), F.size("contributions").alias("features"))


@query()
def feature_importance(f: Frames, **size: int) -> DataFrame:
    _, model = _trained(f, **size)
    return ml.feature_importance(model, f.spark)


@query()
def online_scores(f: Frames) -> DataFrame:
    """Each week's feedback scored by the online model before it learns from that week."""
    inputs = feedback.feedback_features()
    labelled = feedback.resolve_label(f.paired()).withColumns(
        {**inputs, "week": F.date_trunc("week", "feedbackAt").cast("date")}).select(
        "transactionId", "week", "label", *inputs)
    labelled = cut_lineage(labelled)
    weeks = [r["week"] for r in labelled.select("week").distinct().orderBy("week").collect()]  # one a step of learning
    folder = f"{shared_folder(f.spark)}/riskloom-online-{uuid.uuid4().hex}"

    def write(scored: DataFrame, number: int) -> None:
        scored.select("transactionId", "week", "label", F.round("onlineScore", 6).alias("onlineScore")).write.parquet(f"{folder}/step={number}")

    online.learn_in_steps(labelled, "week", weeks, write)
    kind = "transactionId string, week date, label int, onlineScore double"
    return f.spark.read.schema(f"{kind}, step int").parquet(folder).drop("step") if weeks else f.spark.createDataFrame([], kind)


@query()
def text_case_similarity(f: Frames) -> DataFrame:
    """Confirmed cases most like each transaction, by hashed text vectors.

    Query texts repeat heavily, so vectors are made and compared per distinct text.
    """
    stored = case_store.confirmed_cases(f.paired(), F.col("feedbackAt"))
    stored = cut_lineage(stored)
    embedder = ml.fit_text_embedder(stored.select("document"))
    queries = f.featured().select(F.col("transactionId").alias("queryId"), "customerId", tx.query_text().alias("text"))
    known = ml.embed_text(stored, "document", embedder, output="vector").select(
        F.col("id").alias("caseId"), F.col("metadata.customerId").alias("customerId"), "vector")
    return similarity.similar_texts(
        queries, known, lambda texts: ml.embed_text(texts, "text", embedder, output="vector"), Retrieval())
