"""Streaming query wiring: triggers, watermarks, checkpoints and sinks.

Every transform is the batch function; only this package knows about streams.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom import settings as S
from riskloom.functions import features as feat
from riskloom.functions import text as tx
from riskloom.operators import audit, cases, enrich, feedback, panel, similarity
from riskloom.operators.attribution import tree_attributions
from riskloom.operators.ml import LinearModel, embed_text, score, top_attributions
from riskloom.operators.online import OnlineModel
from riskloom.operators.velocity import FIVE_MINUTES
from riskloom.sources import sinks
from riskloom.streaming.state import number_batch

TOP_KIND = "array<struct<feature:string,value:double>>"
Each = Callable[[DataFrame, int], None]
Step = Callable[[DataFrame], DataFrame]


def run(stream: DataFrame, checkpoint: str, each: Each, *, name: str | None = None,
        mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Start a query: all available input once, or every ``every`` interval."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def velocity_counts(txn: DataFrame, size: str = FIVE_MINUTES) -> DataFrame:
    """Tumbling counts with no grace; use output mode ``update`` to see every change."""
    timed = txn.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", "0 seconds")
    return timed.groupBy("customerId", F.window("timestamp", size).alias("w")).agg(
        F.count(F.lit(1)).alias("velocityCount")).select("customerId", F.col("w.start").alias("windowStart"), "velocityCount")


def enriched_batches(folder: str, profiles: DataFrame, each: Each, size: str = FIVE_MINUTES, part: str = "10 seconds") -> Each:
    """Running velocity and a profile snapshot for every batch of transactions, then ``each``.

    Counts are kept in ``folder``, as long as the query's checkpoint.
    """

    def enriched(batch: DataFrame, batch_id: int) -> None:
        each(enrich.join_profile(number_batch(batch, batch_id, folder, size, part), profiles), batch_id)

    return enriched


def card_scorer(model: LinearModel, means: dict[str, float]) -> Step:
    """Score with a linear model: mlFraudScore and the three largest contributions."""
    return lambda featured: featured.withColumns({
        "mlFraudScore": model.probability(), "topFeatures": top_attributions(model.contributions(means))})


def tree_scorer(model: PipelineModel | None) -> Step:
    """Score with a trained pipeline; without one the rows are skipped."""
    def add(featured: DataFrame) -> DataFrame:
        if model is None:
            return score(None, featured).withColumn("topFeatures", F.array().cast(TOP_KIND))
        explained = tree_attributions(model, score(model, featured))
        return explained.withColumn("topFeatures", top_attributions(F.col("contributions"))).drop("contributions", "base", "margin")

    return add


def case_retriever(stored: DataFrame, embedder: PipelineModel, retrieval: S.Retrieval = S.Retrieval()) -> Step:
    """Append ``ragContext`` from the stored cases (id, document, metadata)."""
    known = embed_text(stored, "document", embedder, output="vector").select(
        F.col("id").alias("caseId"), F.col("metadata.customerId").alias("customerId"), "vector")

    def add(featured: DataFrame) -> DataFrame:
        queries = featured.select(F.col("transactionId").alias("queryId"), "customerId", tx.query_text().alias("text"))
        hits = similarity.similar_texts(
            queries, known, lambda texts: embed_text(texts, "text", embedder, output="vector"), retrieval)
        kept = cases.kept_cases(hits, stored)
        joined = featured.join(kept, F.col("transactionId") == F.col("queryId"), "left")
        return joined.withColumn("ragContext", cases.rag_context(F.col("cases"))).drop("queryId", "cases")

    return add


def no_cases(featured: DataFrame) -> DataFrame:
    """The empty context, for a store that holds nothing yet."""
    return featured.withColumn("ragContext", cases.rag_context(F.lit(None).cast(cases.KEPT_KIND)))


def process_batch(folder: str, scorer: Step, model_version: str, retriever: Step = no_cases,
                  audit_write: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: features, score, similar cases, panel, decision, then every output.

    The decided batch is cached once and read by each sink. ``latencyMs`` is the
    measured time from the start of the batch to its decisions, which is what
    each of its transactions waited.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        began = time.monotonic()
        known = retriever(scorer(feat.with_features(batch))).withColumn("casesFound", F.col("ragContext.casesFound"))
        decided = panel.decide(panel.with_panel(known, "casesFound")).persist()
        try:
            decided.count()  # fills the cache that every sink reads
            timed = decided.withColumn("latencyMs", F.lit(int((time.monotonic() - began) * 1000)))
            records = decided.select(F.col("customerId").alias("key"), F.to_json(enrich.enriched_record()).alias("value"))
            sinks.write_enriched(records, f"{folder}/enriched-transactions", batch_id)
            sinks.write_messages(prediction_record(timed, model_version), "customerId", f"{folder}/ml-predictions", batch_id)
            context = tx.context_text(F.col("mlFraudScore"), F.col("ragContext.promptContext"))
            decisions = panel.to_decision_record(decided, F.col("mlFraudScore"), F.col("casesFound"), context)
            sinks.write_messages(decisions, "transactionId", f"{folder}/fraud-decisions", batch_id)
            sinks.write_routes(decisions, folder, batch_id)
            sinks.write_feedback(decisions, folder, batch_id)
            sinks.write_audit(audit_tables(timed, model_version), f"{folder}/audit", batch_id, audit_write)
        finally:
            decided.unpersist()

    return each


def prediction_record(decided: DataFrame, model_version: str) -> DataFrame:
    """The published prediction; the sequence score is a constant zero."""
    top = F.map_from_entries(F.transform("topFeatures", lambda t: F.struct(t["feature"], t["value"])))
    return decided.select(
        "transactionId", "customerId", "mlFraudScore", F.lit(0.0).alias("lstmSequenceScore"),
        F.col("mlFraudScore").alias("combinedScore"), F.lit(model_version).alias("modelVersion"),
        top.alias("shapExplanation"), feat.feature_map().alias("featuresUsed"), "ragContext",
        F.col("latencyMs").cast("long").alias("inferenceLatencyMs"), "timestamp")


def audit_tables(decided: DataFrame, model_version: str) -> dict[str, DataFrame]:
    context = tx.context_text(F.col("mlFraudScore"), F.col("ragContext.promptContext"))
    ready = decided.withColumns({
        "modelVersion": F.lit(model_version), "maxSimilarity": cases.max_similarity(F.col("ragContext")),
        "reasoning": tx.explanation(context, panel.insights_array(), F.col("finalRiskScore")),
    })
    return {"transactions": audit.transaction_rows(ready), "model_predictions": audit.prediction_rows(ready),
            "fraud_decisions": audit.decision_rows(ready)}


def paired_stream(predictions: DataFrame, given: DataFrame, seconds: int = S.PAIRING_SECONDS) -> DataFrame:
    """Stream–stream inner join: either side waits at most the pairing time."""
    delay = f"{int(seconds)} seconds"
    return feedback.pair(predictions.withWatermark("predictedAt", delay), given.withWatermark("feedbackAt", delay), seconds)


def store_cases(folder: str) -> Callable[[DataFrame, int], None]:
    """Append confirmed cases of a paired batch that the store does not hold yet."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cases.confirmed_cases(batch)
        fresh = cases.insert_if_absent(new, stored_cases(spark, folder, new.schema, batch_id))
        sinks.write_batch(fresh, folder, batch_id)

    return each


def stored_cases(spark, folder: str, schema, before: int) -> DataFrame:
    """The store as of earlier batches, so that a replay sees what the first try saw."""
    if before == 0:
        return spark.createDataFrame([], schema)
    kept = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    whole = spark.read.schema(kept).parquet(folder)
    return whole.where(F.col("batch_id") < before).drop("batch_id")


def learn_online(folder: str) -> Callable[[DataFrame, int], None]:
    """Score a feedback batch, write the scores, learn, and write the next model.

    The model of batch n is read from its folder, so a restart continues from it.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        model = load_online(spark, folder, batch_id)
        labelled = feedback.resolve_label(batch).withColumns(feedback.feedback_features()).persist()
        try:
            scored = labelled.select("transactionId", "label", model.probability().alias("onlineScore"))
            sinks.write_batch(scored, f"{folder}/scores", batch_id)
            after = model.learn(labelled)
        finally:
            labelled.unpersist()
        model_row = spark.createDataFrame([(after.updates, after.replaced, after.dump())], "updates long, replaced int, model string")
        sinks.write_batch(model_row.coalesce(1), f"{folder}/model", batch_id)

    return each


def load_online(spark, folder: str, batch_id: int) -> OnlineModel:
    """The model as of the batch before this one (one row)."""
    if batch_id == 0:
        return OnlineModel()
    return OnlineModel.load(spark.read.parquet(f"{folder}/model/batch_id={batch_id - 1}").first()["model"])
