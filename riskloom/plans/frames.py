"""Domain frames derived from the test tables, shared by the registered queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import features as feat
from riskloom.functions import text as tx
from riskloom.operators import audit, cases, feedback, ml, panel, routing, similarity
from riskloom.operators.enrich import with_context
from riskloom.settings import Retrieval
from riskloom.sources import tables

DAY = "1 day"

# A plain score card stands in for a trained model where results are compared.
SCORE_CARD = ml.LinearModel(
    {
        "is_amount_unusual": 1.0, "is_high_velocity": 1.2, "is_unknown_location": 0.9,
        "is_different_city": 0.4, "is_online": 0.2, "is_typical_category": -0.5,
        "is_suspicious_merchant": 1.1, "is_off_hours": 0.4, "is_high_risk_customer": 0.5,
        "is_low_risk_customer": -0.4, "is_bot_device": 1.3, "is_rapid_fire": 1.0,
    },
    -3.0,
)


def _once(build):
    """Compose a frame once per :class:`Frames` and hand out the same plan after that."""

    @functools.wraps(build)
    def kept(self):
        if build.__name__ not in self._made:
            self._made[build.__name__] = build(self)
        return self._made[build.__name__]

    return kept


class Frames:
    """Lazily composed frames over one folder; nothing runs until a result is read."""

    def __init__(self, spark: SparkSession, folder: str, size: str = DAY):
        self.spark, self.folder, self.size = spark, folder, size
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.folder, name)

    @_once
    def transactions(self) -> DataFrame:
        return tables.transactions(self.spark, self.folder)

    @_once
    def profiles(self) -> DataFrame:
        return tables.profiles(self.spark, self.folder)

    @_once
    def enriched(self) -> DataFrame:
        return with_context(self.transactions(), self.profiles(), self.size)

    @_once
    def featured(self) -> DataFrame:
        return feat.with_features(self.enriched())

    @_once
    def paneled(self) -> DataFrame:
        return panel.with_panel(self.featured())

    @_once
    def decided(self) -> DataFrame:
        return routing.with_route(panel.decide(self.paneled()))

    @_once
    def scored(self) -> DataFrame:
        """Decisions with the score card's model score."""
        return self._scored(self.decided())

    @staticmethod
    def _scored(decided: DataFrame) -> DataFrame:
        return decided.withColumns({
            "mlFraudScore": SCORE_CARD.probability(),
            "latencyMs": F.col("metadata.sequence") + 40,
            "modelVersion": F.lit("card-v1"),
        })

    @_once
    def labels(self) -> DataFrame:
        return self.table("labels").select(
            F.concat(F.lit("TXN-"), F.col("doc_id").cast("string")).alias("labelledId"),
            (F.col("toxic") == 1).alias("actualFraud"), (F.col("quality") == 1).alias("qualityLabel"),
        )

    @_once
    def feedback(self) -> DataFrame:
        """Automatic feedback for every decision, with a person's label where one exists."""
        labels = self.labels()
        decided = self.decided()
        joined = decided.join(labels, decided["transactionId"] == labels["labelledId"], "left")
        labelled, wait = F.col("labelledId").isNotNull(), F.col("metadata.sequence") * 6
        return joined.select(
            "transactionId",
            F.col("isFraudulent").alias("predictedFraud"),
            "actualFraud",
            F.col("confidenceScore").alias("confidence"),
            F.col("agentCount").alias("agentConsensus"),
            "fraudPattern",
            F.when(labelled, "ANALYST").otherwise("AUTO_SYSTEM").alias("source"),
            (F.col("timestamp") + F.make_dt_interval(secs=wait)).alias("feedbackAt"),
            F.when(labelled, F.concat(F.lit("ANALYST-"), (F.col("metadata.sequence") % 7).cast("string")))
            .alias("analystId"),
            F.when(labelled, wait).alias("reviewTimeSeconds"),
        )

    @_once
    def predictions(self) -> DataFrame:
        return self.scored().select(
            "transactionId", "customerId", "mlFraudScore", F.col("timestamp").alias("predictedAt"), *S.FEATURES)

    @_once
    def paired(self) -> DataFrame:
        return feedback.pair(self.predictions(), self.feedback(), seconds=None)

    @_once
    def all_feedback(self) -> DataFrame:
        """Feedback on every decision, and people's labels for transactions that were never decided."""
        labels, decided = self.labels(), self.feedback()
        unseen = labels.join(decided, labels["labelledId"] == decided["transactionId"], "left_anti").select(
            F.col("labelledId").alias("transactionId"), "actualFraud", F.lit("ANALYST").alias("source"))
        return decided.unionByName(unseen, allowMissingColumns=True)

    def vectors(self) -> DataFrame:
        key = F.col("vec_id")
        return self.table("embeddings").select(
            key.alias("id"), F.col("embedding").alias("vector"),
            F.concat(F.lit("CUST-"), (key % 20).cast("string")).alias("customerId"), "label")

    def vector_cases(self) -> DataFrame:
        """Confirmed cases whose vectors are given; the label picks the pattern."""
        label = F.col("label")
        pattern = F.element_at(F.array(*[F.lit(p) for p in S.PATTERNS]), label % 4 + 1)
        by = F.when(label < 5, "human_analyst").otherwise("system")
        key = F.col("id").cast("string")
        return self.vectors().select(
            F.col("id"),
            tx.join_text("fraud pattern: ", pattern, "\n", tx.CASE_INDENT, "case label: ", label.cast("string"))
            .alias("document"),
            F.col("vector").alias("embedding"),
            F.struct(
                F.concat(F.lit("TXN-"), key).alias("transactionId"), "customerId", pattern.alias("fraudPattern"),
                F.round(label * 0.03 + 0.7, 2).alias("confidence"), by.alias("confirmedBy"),
                F.lit("2024-01-15T00:00:00").alias("embeddedAt"),
            ).alias("metadata"),
        )

    def hits(self, threshold: float) -> DataFrame:
        """Every stored vector queried against all other stored cases."""
        queries = self.vectors().select(F.col("id").alias("queryId"), "customerId", "vector")
        stored = self.vectors().select(F.col("id").alias("caseId"), "customerId", "vector")
        return similarity.similar_cases(queries, stored, Retrieval(threshold=threshold))

    def contexts(self, threshold: float = 0.10) -> DataFrame:
        """(queryId, context) for the queries that kept at least one case."""
        kept = cases.kept_cases(self.hits(threshold), self.vector_cases())
        return kept.select("queryId", cases.rag_context(F.col("cases")).alias("context"))

    def feed_records(self) -> DataFrame:
        from riskloom.operators import monitor

        context = self.contexts().select(
            F.concat(F.lit("TXN-"), F.col("queryId").cast("string")).alias("contextId"),
            F.col("context.casesFound").alias("casesFound"),
            F.col("context.cases")[0]["similarity"].alias("topSimilarity"),
            F.col("context.cases")[0]["fraudPattern"].alias("topCasePattern"),
        )
        paired = self.paired()
        joined = paired.join(context, paired["transactionId"] == context["contextId"], "left")
        return monitor.feed_records(joined)

    # --- audit tables -----------------------------------------------------

    def _number(self):
        return F.substring("transactionId", 5, 20).cast("long")

    @_once
    def audit_transactions(self) -> DataFrame:
        return audit.transaction_rows(self.featured())

    @_once
    def attributed(self) -> DataFrame:
        """Scored decisions with the largest contributions to the score."""
        return ml.with_attributions(self.scored(), SCORE_CARD)

    @_once
    def investigated(self) -> DataFrame:
        """Scored decisions with what they were decided on: attributions and the similar confirmed cases.

        The transaction and the vector of the same number belong together. The
        join key is the contexts' grouping key, so Spark drops the join, and the
        search with it, where no context column is read. Transactions are joined
        before they are decided on, while their rows are narrow.
        """
        contexts = self.contexts().withColumnRenamed("context", "ragContext")
        joined = self.enriched().join(contexts, self._number() == contexts["queryId"], "left").drop("queryId")
        decided = routing.with_route(panel.decide(panel.with_panel(feat.with_features(joined))))
        attributed = ml.with_attributions(self._scored(decided), SCORE_CARD, over=self.scored())
        return attributed.withColumns({
            "casesFound": F.coalesce("ragContext.casesFound", F.lit(0)),
            "maxSimilarity": cases.max_similarity(F.col("ragContext")),
            "context": tx.context_text(F.col("mlFraudScore"), F.col("ragContext.promptContext")),
        })

    @_once
    def audit_predictions(self) -> DataFrame:
        return audit.prediction_rows(self.attributed(), self._number())

    @_once
    def audit_decisions(self) -> DataFrame:
        """Every decision with its computed attributions, retrieved cases and explanation."""
        told = tx.explanation(F.col("context"), panel.insights_array(), F.col("finalRiskScore"))
        return audit.decision_rows(self.investigated().withColumn("reasoning", told), self._number())

    @_once
    def audit_reviews(self) -> DataFrame:
        return feedback.case_review_record(self.feedback(), self._number())

    def audit_labels(self) -> DataFrame:
        return self.labels().select(
            F.col("labelledId").alias("transaction_id"), F.lit("xgboost").alias("model_type"),
            F.col("actualFraud").alias("actual_label"),
            F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
