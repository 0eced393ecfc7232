"""Text projections: number formats, context, case and explanation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import features as feat
from riskloom.functions.numbers import rounded

# The layout of stored case text, of query text and of prompts.
CASE_INDENT = " " * 12
QUERY_INDENT = " " * 8
CASE_HEADER = "SIMILAR CONFIRMED FRAUD CASES FROM HISTORY:"
CASE_FOOTER = "Use these cases as precedent. Higher similarity = more relevant to current transaction."
NO_CONTEXT = "No additional streaming context available."
EXPLANATION_TITLE = "AI AGENTS ENHANCED WITH STREAMING INTELLIGENCE\n"
DASH = "—"


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, rounding the exact binary value half to even.

    ``format_string`` rounds the shortest decimal form half up, which differs
    on ties such as 0.125, so the decimal-format overload is used instead.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def plain(value: Column) -> Column:
    """A double as text in plain notation with at least one decimal."""
    return F.call_function("format_number", value.cast("double"), F.lit("0.0###############"))


def join_text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def is_set(name: str) -> Column:
    return F.col(name) == 1


def merchant_type() -> Column:
    suspicious, online = is_set("is_suspicious_merchant"), is_set("is_online")
    return (
        F.when(suspicious & online, "suspicious online").when(suspicious, "suspicious")
        .when(online, "online").otherwise("in-person")
    )


def location_status() -> Column:
    return F.when(is_set("is_unknown_location"), "unknown/vpn").otherwise("known location")


def risk_tier() -> Column:
    return (
        F.when(is_set("is_high_risk_customer"), "HIGH").when(is_set("is_low_risk_customer"), "LOW")
        .otherwise("MEDIUM")
    )


def device_text() -> Column:
    return F.when(is_set("is_bot_device"), "bot device detected").otherwise("normal device")


def ml_band(score: Column) -> Column:
    return (
        F.when(score >= 0.7, "ML strongly indicates fraud.")
        .when(score >= 0.3, "ML indicates moderate risk.")
        .otherwise("ML indicates likely legitimate.")
    )


def observable_lines() -> list[Column]:
    """The eight lines shared by stored cases and queries, so their vocabularies match."""
    return [
        join_text("velocity: ", F.col("velocity_count").cast("string"), " transactions in 5 minutes ",
                  F.when(is_set("is_high_velocity"), "(high velocity attack)").otherwise("")),
        join_text("amount ratio: ", fixed(F.col("amount_ratio"), 2), "x customer baseline ",
                  F.when(is_set("is_amount_unusual"), "(unusual amount)").otherwise("")),
        join_text("merchant: ", merchant_type(), " ",
                  F.when(is_set("is_typical_category"), "").otherwise("(atypical category)")),
        join_text("location: ", location_status()),
        join_text("device: ", device_text()),
        join_text("rapid fire flag: ", F.when(is_set("is_rapid_fire"), "yes").otherwise("no")),
        join_text("transaction hour: ", F.col("hour").cast("string"), ":00"),
        join_text("customer risk tier: ", risk_tier()),
    ]


def query_text() -> Column:
    return F.concat_ws("\n" + QUERY_INDENT, *observable_lines())


def confirmed_by_text() -> Column:
    return F.when(F.col("actualFraud").isNotNull(), "human_analyst").otherwise("system_high_confidence")


def case_text() -> Column:
    """Fourteen lines describing one confirmed case."""
    return F.concat_ws(
        "\n" + CASE_INDENT,
        join_text("fraud pattern: ", F.col("fraudPattern")),
        *observable_lines(),
        join_text("ml fraud score: ", fixed(F.col("mlFraudScore"), 3)),
        join_text("agent consensus: ", F.col("agentConsensus").cast("string"), " agents agreed"),
        join_text("decision confidence: ", fixed(F.col("confidence"), 2)),
        F.lit("outcome: FRAUD CONFIRMED"),
        join_text("confirmed by: ", confirmed_by_text()),
    )


def context_text(score: Column | None = None, cases: Column | None = None,
                 high_velocity: int = S.HIGH_VELOCITY) -> Column:
    """The parts of the streaming context that are present, one per line."""
    count = F.col("velocityCount")
    parts = [
        F.when(count >= high_velocity,
               join_text("HIGH VELOCITY: ", count.cast("string"), " transactions in the last 5 minutes")),
        F.when(feat.has_profile(),
               join_text("Customer baseline: $", fixed(F.col("profile.averageTransactionAmount"), 2), " avg, ",
                         F.col("profile.riskLevel"), " risk.")),
    ]
    if score is not None:
        percent = plain(rounded(score * 100, 1))
        parts.append(F.when(score.isNotNull(), join_text(
            "ML MODEL PRE-SCREEN: XGBoost fraud score = ", percent, "%. ", ml_band(score))))
    if cases is not None:
        parts.append(F.nullif(cases, F.lit("")))
    text = F.concat_ws("\n", *parts)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_CONTEXT))


def _shown(value: Column, missing: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def _truth(value: Column, missing: str) -> Column:
    return F.when(value, "True").when(~value, "False").otherwise(missing)


def transaction_lines(prompt: bool) -> Column:
    """The transaction block: the prompt form also shows the channel."""
    meta = F.col("metadata")
    first = "Transaction ID: " if prompt else "ID: "
    gap = "unknown" if prompt else "None"
    lines = [
        join_text(first, F.col("transactionId")),
        join_text("Amount: $", plain(F.col("amount")), " ", F.col("currency")),
        join_text("Merchant: ", F.col("merchantId"), " (", F.col("merchantCategory"), ")"),
        join_text("Location: ", F.col("location")),
        join_text("Device: ", _shown(meta["deviceId"], gap)),
    ]
    if prompt:
        lines.append(join_text("Channel: ", _shown(meta["channel"], gap)))
    lines.append(join_text("Rapid fire: ", _truth(meta["rapidFire"], "False" if prompt else "None")))
    text = F.concat_ws("\n", *lines)
    return F.concat(text, F.lit("\n")) if prompt else text


def explanation(context: Column, insights: Column, final_risk: Column) -> Column:
    """Transaction, context, one line per insight and the verdict."""
    lines = F.transform(insights, lambda i: F.concat(
        F.lit("- "), i["agentName"], F.lit(" (Risk: "), fixed(i["riskScore"] * 100, 1),
        F.lit("%): "), F.substring(i["reasoning"], 1, 150)))
    verdict = F.when(final_risk >= S.FRAUD_RISK, "FRAUD DETECTED").otherwise("LEGITIMATE")
    return F.concat_ws(
        "\n",
        F.lit(EXPLANATION_TITLE),
        join_text("TRANSACTION:\n", transaction_lines(prompt=False), "\n"),
        join_text("STREAMING CONTEXT:\n", context, "\n"),
        F.lit("AGENT ANALYSIS:"),
        F.array_join(lines, "\n"),
        join_text("\nFINAL RISK SCORE: ", fixed(final_risk * 100, 1), "%\nDECISION: ", verdict),
    )


def case_block(cases: Column) -> Column:
    """Numbered, indented block of retrieved cases; empty text when there are none.

    ``cases`` holds text, similarity, fraudPattern, confidence, confirmedBy,
    embeddedAt and transactionId in the order they were kept.
    """
    def one(case: Column, index: Column) -> Column:
        txn = F.coalesce(case["transactionId"], F.lit("unknown"))
        return F.concat(
            F.lit("Case "), (index + 1).cast("string"),
            F.lit(" (similarity: "), (case["similarity"] * 100).cast("int").cast("string"),
            F.lit("%, pattern: "), F.coalesce(case["fraudPattern"], F.lit("unknown")),
            F.lit(", confidence: "), fixed(F.coalesce(case["confidence"], F.lit(0.0)), 2),
            F.lit(", txn: ..."), F.right(txn, F.lit(8)),
            F.lit(", confirmed: "), F.substring(F.coalesce(case["embeddedAt"], F.lit("")), 1, 10),
            F.lit(", by: "), F.coalesce(case["confirmedBy"], F.lit("system")), F.lit("):\n"),
            F.lit("  "), F.replace(case["text"], F.lit("\n"), F.lit("\n  ")), F.lit("\n"),
        )

    body = F.array_join(F.transform(cases, one), "\n")
    return F.when(F.size(cases) > 0, F.concat_ws("\n", F.lit(CASE_HEADER), F.lit(""), body, F.lit(CASE_FOOTER))) \
        .otherwise("")
