"""The weighted rule panel and the decision it yields.

Five agents score each transaction from its features. Two of them answer a
velocity question when velocity is high, two answer a profile question when a
profile exists, and a consensus row closes the panel. The rule points are this
project's own; weights, thresholds and tiers are fixed values.

The wide form (one column per answer) needs no shuffle and stays in codegen.
The long form takes insights from any source, such as parsed agent responses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import features as feat
from riskloom.functions import text as tx

# Agent names and weights.
BEHAVIOR, PATTERN, RISK = "BEHAVIOR_ANALYST", "PATTERN_DETECTOR", "RISK_ASSESSOR"
GEOGRAPHIC, TEMPORAL = "GEOGRAPHIC_ANALYST", "TEMPORAL_ANALYST"
CONSENSUS = "STREAMING_CONSENSUS_COORDINATOR"
WEIGHTS = {BEHAVIOR: 1.2, PATTERN: 1.3, RISK: 1.1, GEOGRAPHIC: 1.0, TEMPORAL: 1.0, CONSENSUS: 0.8}
VELOCITY_ROUND = (PATTERN, TEMPORAL)
PROFILE_ROUND = (BEHAVIOR, RISK)


@dataclass(frozen=True)
class Agent:
    """One panel member: a base score plus points per raised feature flag."""

    name: str
    base: float
    points: tuple[tuple[str, float], ...]

    @property
    def weight(self) -> float:
        return WEIGHTS[self.name]

    @property
    def column(self) -> str:
        return self.name.split("_")[0].lower() + "_risk"

    def score(self) -> Column:
        gains = " + ".join(f"{gain}D * {flag}" for flag, gain in self.points)
        return F.expr(bounded(f"{self.base}D + {gains}"))

    def signals(self) -> Column:
        raised = ", ".join(
            f"IF({flag} = 1, '{flag.removeprefix('is_').replace('_', ' ')}', NULL)" for flag, _ in self.points)
        return F.expr(f"coalesce('signals: ' || nullif(concat_ws(', ', {raised}), ''), 'no signals')")


AGENTS = (
    Agent(BEHAVIOR, 0.25, (("is_amount_unusual", 0.30), ("is_high_velocity", 0.30),
                           ("is_typical_category", -0.15), ("is_rapid_fire", 0.20))),
    Agent(PATTERN, 0.10, (("is_high_velocity", 0.25), ("is_suspicious_merchant", 0.25),
                          ("is_bot_device", 0.25), ("is_rapid_fire", 0.20))),
    Agent(RISK, 0.10, (("is_amount_unusual", 0.30), ("is_high_risk_customer", 0.25),
                       ("is_low_risk_customer", -0.05), ("is_high_velocity", 0.20),
                       ("is_suspicious_merchant", 0.15))),
    Agent(GEOGRAPHIC, 0.10, (("is_unknown_location", 0.55), ("is_different_city", 0.30),
                             ("is_suspicious_merchant", 0.10), ("is_primary_location", -0.05))),
    Agent(TEMPORAL, 0.10, (("is_off_hours", 0.20), ("is_high_velocity", 0.30),
                           ("is_rapid_fire", 0.30), ("is_bot_device", 0.10), ("is_weekend", 0.05))),
)
BY_NAME = {agent.name: agent for agent in AGENTS}


def bounded(score: str, digits: int = 4) -> str:
    return f"round(greatest(0D, least(1D, {score})), {digits})"


def _follow_up_column(name: str) -> str:
    return BY_NAME[name].column + "_followup"


def pattern_label() -> Column:
    """Attack pattern from the current features."""
    return F.expr("""
        CASE WHEN is_high_velocity = 1 AND is_bot_device = 1 AND is_rapid_fire = 1 THEN 'card_testing'
             WHEN is_bot_device = 1 AND is_unknown_location = 1 THEN 'vpn_bot_fraud'
             WHEN is_amount_unusual = 1 AND is_different_city = 1 THEN 'account_takeover'
             ELSE 'general_fraud' END""")


AUTOMATED = "is_bot_device = 1 OR is_rapid_fire = 1"
EXPOSED = "is_amount_unusual = 1 OR is_high_risk_customer = 1"


def with_panel(featured: DataFrame, cases_found: str | None = None) -> DataFrame:
    """Append every panel answer as a column (follow-ups are null when not asked).

    ``cases_found`` names a column with the number of similar confirmed cases.
    """
    scored = featured.withColumns({agent.column: agent.score() for agent in AGENTS})
    names = ", ".join(a.column for a in AGENTS)
    mean = (" + ".join(f"{a.column} * {a.weight}D" for a in AGENTS), sum(a.weight for a in AGENTS))
    consensus = f"({mean[0]}) / {mean[1]}D + IF(greatest({names}) >= 0.8D, 0.1D, 0D)"
    if cases_found is not None:
        consensus += f" + IF({cases_found} > 0, 0.05D, 0D)"
    follow_ups = {}
    for asked, when, worse, gain in ((VELOCITY_ROUND, "is_high_velocity = 1", AUTOMATED, 0.1),
                                     (PROFILE_ROUND, "profile IS NOT NULL", EXPOSED, 0.05)):
        for name in asked:
            answer = bounded(f"{BY_NAME[name].column} + IF({worse}, {gain}D, -0.05D)")
            follow_ups[_follow_up_column(name)] = F.expr(f"IF({when}, {answer}, NULL)")
    return scored.withColumns({
        **follow_ups,
        "consensus_risk": F.expr(bounded(consensus, 3)),
        "panel_pattern": pattern_label(),
    })


def answer_columns() -> list[tuple[str, str, str]]:
    """(agent, round, column) for every possible answer, in panel order."""
    return (
        [(a.name, "first", a.column) for a in AGENTS]
        + [(n, "velocity", _follow_up_column(n)) for n in VELOCITY_ROUND]
        + [(n, "profile", _follow_up_column(n)) for n in PROFILE_ROUND]
        + [(CONSENSUS, "consensus", "consensus_risk")]
    )


def recommendation(risk: Column) -> Column:
    return F.when(risk >= 0.8, "FRAUD_ALERT").when(risk >= 0.6, "HUMAN_REVIEW").otherwise("APPROVE")


def insights_array() -> Column:
    """The given answers as ``array<struct>``: 6, 8 or 10 elements per transaction."""
    def one(name: str, asked: str, column: str) -> Column:
        risk = F.col(column)
        if name == CONSENSUS:
            words = F.concat(F.lit("panel consensus: "), F.col("panel_pattern"))
        else:
            words = BY_NAME[name].signals()
        pattern = F.col("panel_pattern") if name == CONSENSUS else F.lit("unknown")
        return F.when(risk.isNotNull(), F.struct(
            F.lit(name).alias("agentName"), F.lit(asked).alias("round"), risk.alias("riskScore"),
            risk.alias("confidence"), F.lit(WEIGHTS[name]).alias("weight"), words.alias("reasoning"),
            recommendation(risk).alias("recommendation"), pattern.alias("pattern"),
        ))

    return F.array_compact(F.array(*[one(*answer) for answer in answer_columns()]))


def long_insights(paneled: DataFrame) -> DataFrame:
    """One row per (transaction, answer)."""
    return paneled.select("transactionId", F.inline(insights_array()))


def all_insights(*rounds: DataFrame) -> DataFrame:
    """First-round, follow-up and consensus rows as one set."""
    united = rounds[0]
    for other in rounds[1:]:
        united = united.unionByName(other, allowMissingColumns=True)
    return united


# --- scoring pieces -------------------------------------------------------

def weighted_risk() -> Column:
    """Weighted mean over the answers that were given (wide form)."""
    answers = [(column, WEIGHTS[name]) for name, _, column in answer_columns()]
    score = " + ".join(f"coalesce({c} * {w}D, 0D)" for c, w in answers)
    weight = " + ".join(f"IF({c} IS NULL, 0D, {w}D)" for c, w in answers)
    return F.expr(f"coalesce(try_divide({score}, {weight}), 0.5D)")


def streaming_bonus() -> Column:
    return F.expr("IF(is_high_velocity = 1, 0.25D, 0D) + IF(is_amount_unusual = 1, 0.2D, 0D)"
                  " + IF(is_high_risk_customer = 1, 0.1D, 0D)")


def disagreement() -> Column:
    """First-round spread above the limit, compared in exact decimals."""
    names = ", ".join(a.column for a in AGENTS)
    return F.expr(f"round(greatest({names}) - least({names}), 4) > {S.DISAGREEMENT}D")


def insight_count() -> Column:
    return F.expr("6 + IF(is_high_velocity = 1, 2, 0) + IF(profile IS NOT NULL, 2, 0)")


def agreement_tier(share: Column) -> Column:
    """Confidence tier from the share of answers that agree with the verdict."""
    return (
        F.when(share >= 0.8, 0.9).when(share >= 0.6, 0.7).when(share >= 0.4, 0.5).otherwise(0.3)
    )


def agreement_share(verdict: str = "isFraudulent") -> Column:
    columns = [column for _, _, column in answer_columns()]
    agreeing = " + ".join(f"IF(({c} >= {S.FRAUD_RISK}D) = {verdict}, 1, 0)" for c in columns)
    asked = " + ".join(f"IF({c} IS NULL, 0, 1)" for c in columns)
    return F.expr(f"try_divide(CAST({agreeing} AS DOUBLE), {asked})")


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append columns through a one-row generator.

    Filters on them stay above the generator. Pushed down instead, a filter
    on a decision would be rewritten in terms of the raw inputs, repeating
    the whole rule panel many times over in one expression.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def decide(paneled: DataFrame) -> DataFrame:
    """Verdict, confidence, pattern and counts for each transaction (no shuffle).

    The wide form always has a consensus answer, so the confidence is its
    risk; :func:`agreement_tier` is the fallback of the long form.
    """
    summed = paneled.withColumns({"baseRisk": weighted_risk(), "streamingBonus": streaming_bonus()})
    final = F.expr("least(1D, baseRisk + streamingBonus)")
    return computed_once(summed, {
        "finalRiskScore": final,
        "isFraudulent": final >= S.FRAUD_RISK,
        "confidenceScore": F.round("consensus_risk", 3),
        "fraudPattern": F.col("panel_pattern"),
    }).withColumns({"hasDisagreement": disagreement(), "agentCount": insight_count()})


def decide_long(insights: DataFrame, flat: DataFrame) -> DataFrame:
    """Same decision from long-form insights and flat transactions.

    Insights are reduced to one row per transaction with partial aggregation
    before the join.
    """
    consensus, first = F.col("agentName") == CONSENSUS, F.col("round") == "first"
    risk, weight = F.col("riskScore"), F.col("weight")
    fraud_votes = F.sum(F.when(risk >= S.FRAUD_RISK, 1).otherwise(0))
    totals = insights.groupBy("transactionId").agg(
        F.sum(risk * weight).alias("_score"), F.sum(weight).alias("_weight"),
        F.count(F.lit(1)).cast("int").alias("agentCount"),
        fraud_votes.alias("_fraud"),
        F.count(F.when(first, 1)).alias("_first"),
        (F.max(F.when(first, risk)) - F.min(F.when(first, risk))).alias("_spread"),
        F.max(F.when(consensus, risk)).alias("_consensus"),
        F.max(F.when(consensus, F.col("pattern"))).alias("_pattern"),
    )
    bonus = (
        F.when(F.col("hasHighVelocity"), 0.25).otherwise(0.0)
        + F.when(F.col("isAmountUnusual"), 0.20).otherwise(0.0)
        + F.when(F.col("customerRiskLevel") == "HIGH", 0.10).otherwise(0.0)
    )
    base = F.when(F.col("_weight") > 0, F.try_divide("_score", "_weight")).otherwise(0.5)
    agreeing = F.when(F.col("isFraudulent"), F.col("_fraud")).otherwise(F.col("agentCount") - F.col("_fraud"))
    share = F.try_divide(agreeing.cast("double"), F.col("agentCount"))
    return (
        flat.join(totals, "transactionId", "left")
        .withColumns({"baseRisk": base, "streamingBonus": bonus,
                      "agentCount": F.coalesce("agentCount", F.lit(0))})
        .withColumn("finalRiskScore", F.least(F.lit(1.0), F.col("baseRisk") + F.col("streamingBonus")))
        .withColumn("isFraudulent", F.col("finalRiskScore") >= S.FRAUD_RISK)
        .withColumns({
            "hasDisagreement": F.coalesce(
                (F.col("_first") >= 2) & (F.round("_spread", 4) > S.DISAGREEMENT), F.lit(False)),
            "confidenceScore": F.round(F.coalesce("_consensus", agreement_tier(share)), 3),
            "fraudPattern": F.coalesce("_pattern", F.lit("unknown")),
        })
        .drop("_score", "_weight", "_fraud", "_first", "_spread", "_consensus", "_pattern")
    )


# Reason text by verdict.
FRAUD_REASON = "AI agents with streaming intelligence detected fraud"
CLEAR_REASON = "Transaction appears legitimate"


def to_decision_record(decided: DataFrame, score: Column, cases_found: Column, context: Column) -> DataFrame:
    """The published decision record."""
    insights = F.transform(F.col("_insights"), lambda i: F.struct(
        i["agentName"].alias("agentType"), i["agentName"].alias("agentName"),
        i["reasoning"].alias("analysis"), i["riskScore"].alias("riskScore"),
        F.least(i["riskScore"], F.lit(1.0)).alias("confidence"), i["reasoning"].alias("reasoning"),
        i["recommendation"].alias("recommendation"), F.col("timestamp").alias("timestamp"),
    ))
    return decided.withColumn("_insights", insights_array()).select(
        "transactionId",
        "isFraudulent",
        "confidenceScore",
        F.when(F.col("isFraudulent"), FRAUD_REASON).otherwise(CLEAR_REASON).alias("primaryReason"),
        tx.explanation(context, F.col("_insights"), F.col("finalRiskScore")).alias("detailedExplanation"),
        insights.alias("agentInsights"),
        F.create_map(
            F.lit("finalRiskScore"), F.col("finalRiskScore"),
            F.lit("mlFraudScore"), score.cast("double"),
            F.lit("ragCasesFound"), cases_found.cast("double"),
        ).alias("riskFactors"),
        F.col("timestamp").alias("analyzedAt"),
        "fraudPattern",
    )
