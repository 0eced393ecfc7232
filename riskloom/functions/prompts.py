"""Agent prompts as text columns, and parsing of agent responses in bulk.

Calling a remote model is outside this package: prompts leave as a table and
responses come back as a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions import text as tx
from riskloom.operators import panel

# Wording each agent is asked with, and the response format.
RESPONSE_FORMAT = (
    "\n\nAnswer with these lines and nothing else:\n"
    "RISK_SCORE: [0.0-1.0]\n"
    "REASONING: [your analysis]\n"
    "RECOMMENDATION: [FRAUD_ALERT|HUMAN_REVIEW|APPROVE]"
)


@dataclass(frozen=True)
class Wording:
    role: str
    title: str
    questions: tuple[str, str, str, str]
    focus: str
    precedent: str


WORDING = {
    panel.BEHAVIOR: Wording(
        "comparing this payment with the customer's habits", "analyst of customer behaviour",
        ("How far is the amount from what this customer usually pays?",
         "Is the number of recent payments normal for this customer?",
         "Has the customer used this kind of shop and channel before?",
         "Does the rhythm of the payments look like a person's?"),
        "the customer's habits", "break with habit"),
    panel.PATTERN: Wording(
        "matching this payment with known schemes", "analyst of attack schemes",
        ("Do many small payments in a row point to tested cards?",
         "Are the shop and the place known from earlier schemes?",
         "Could the device be a program rather than a phone or till?",
         "Do the flags and the amount together point to probing?"),
        "known schemes", "scheme"),
    panel.RISK: Wording(
        "weighing what is at stake", "analyst of financial exposure",
        ("How large is the possible loss for this customer?",
         "What does the customer's risk level add or take away?",
         "By how much do recent payments raise the odds of fraud?",
         "How risky is this kind of shop?"),
        "exposure and risk level", "level of exposure"),
    panel.GEOGRAPHIC: Wording(
        "checking where this payment came from", "analyst of places",
        ("Is this the customer's home or a place they visit?",
         "Is the place hidden, as behind a relay?",
         "Could one person have reached it since the last payment?",
         "Have confirmed cases come from this place?"),
        "places", "hidden or distant place"),
    panel.TEMPORAL: Wording(
        "checking when this payment came", "analyst of timing",
        ("Are the gaps between payments too short for a person?",
         "Is this an hour at which the customer usually pays?",
         "Do speed and number of payments point to a script?",
         "Would a person or a program explain the timing better?"),
        "timing", "timing"),
}


def precedent_line(wording: Wording) -> str:
    return (f"\nWhere a confirmed case above has this {wording.precedent}, "
            "let it count for more than a first impression.\n")


def analysis_prompt(name: str, context: Column) -> Column:
    """First-round prompt; the case instruction appears only with cases in the context."""
    w = WORDING[name]
    asked = "\n".join(f"{n}. {q}" for n, q in enumerate(w.questions, 1))
    has_cases = context.contains(tx.CASE_HEADER.rstrip(":"))
    return tx.join_text(
        f"You are a {w.title} {w.role}.\n\nSTREAMING INTELLIGENCE:\n", context,
        "\n\nTRANSACTION:\n", tx.transaction_lines(prompt=True), f"\nAnalyze:\n{asked}\n",
        F.when(has_cases, precedent_line(w)).otherwise(""), RESPONSE_FORMAT)


def follow_up_prompt(name: str, question: Column) -> Column:
    w = WORDING[name]
    return tx.join_text(
        f"Desk: {w.title}.\nOpen question on this payment:\n\n", question, "\n\nTRANSACTION:\n",
        tx.transaction_lines(prompt=True), f"\nKeep to {w.focus}.\n", RESPONSE_FORMAT)


def agent_prompts(transactions: DataFrame, context: str = "context") -> DataFrame:
    """One first-round prompt row per (transaction, agent); the rows come from an inline array."""
    rows = F.array(*[
        F.struct(F.lit(a.name).alias("agentName"), analysis_prompt(a.name, F.col(context)).alias("prompt"))
        for a in panel.AGENTS
    ])
    return transactions.select("transactionId", F.inline(rows))


def velocity_question(count: Column) -> Column:
    return tx.join_text("The current window holds ", count.cast("string"), " payments of this customer. "
                        "Would you expect that from a person?")


def profile_question(average: Column, risk: Column) -> Column:
    return tx.join_text("This customer pays $", tx.fixed(average, 0), " on average and is rated ", risk,
                        ". What does that change for you?")


def consensus_prompt(context: Column, insights: Column) -> Column:
    """Consensus prompt over first-round insights only (200 characters of each)."""
    lines = F.transform(insights, lambda i: F.concat(
        i["agentName"], F.lit(" (Risk: "), tx.fixed(i["riskScore"], 2), F.lit("): "),
        F.substring(i["reasoning"], 1, 200)))
    return tx.join_text(
        "Close this case for the desk.\n\nSTREAMING CONTEXT:\n", context,
        "\n\nTRANSACTION:\n", tx.transaction_lines(prompt=False), "\n\nAGENT FINDINGS:\n",
        F.array_join(lines, "\n"),
        "\n\nSet what the stream shows, what the desk found and what earlier cases proved against each other.",
        RESPONSE_FORMAT, "\nPATTERN: [" + "|".join(S.PATTERNS) + "]")


def follow_up_prompts(paneled: DataFrame, context: str = "context") -> DataFrame:
    """Velocity, profile and consensus prompts of each transaction."""
    from riskloom.functions import features as feat

    def row(asked: str, name: str, text: Column) -> Column:
        return F.struct(F.lit(asked).alias("round"), F.lit(name).alias("agentName"), text.alias("prompt"))

    velocity = velocity_question(F.coalesce("velocityCount", F.lit(0)))
    profile = profile_question(F.col("profile.averageTransactionAmount"), feat.risk_level())
    first = F.filter(panel.insights_array(), lambda i: i["round"] == "first")
    rows = (
        [F.when(tx.is_set("is_high_velocity"), row("velocity", n, follow_up_prompt(n, velocity)))
         for n in panel.VELOCITY_ROUND]
        + [F.when(feat.has_profile(), row("profile", n, follow_up_prompt(n, profile)))
           for n in panel.PROFILE_ROUND]
        + [row("consensus", panel.CONSENSUS, consensus_prompt(F.col(context), first))]
    )
    return paneled.select("transactionId", F.inline(F.array_compact(F.array(*rows))))


# The fields of an agent response.
RISK_FIELD = r"(?i)RISK_SCORE:\s*([0-9.]+)"
REASONING_FIELD = r"(?imsd)REASONING:\s*(.+?)(?=RECOMMENDATION:|PATTERN:|$)"
RECOMMENDATION_FIELD = r"(?imsd)RECOMMENDATION:\s*([^\r\n]+)"
PATTERN_FIELD = r"(?imsd)PATTERN:\s*(" + "|".join(S.PATTERNS) + ")"
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def parse_agent_text(responses: DataFrame, column: str = "response") -> DataFrame:
    """Risk, reasoning, recommendation and pattern from response text.

    An absent or malformed score reads as 0.5, an unlisted pattern as unknown.
    """
    text = F.coalesce(column, F.lit(""))

    def words(pattern: str) -> Column:
        return F.regexp_replace(F.regexp_extract(text, pattern, 1), EDGE_SPACE, "")

    number = F.coalesce(F.regexp_extract(text, RISK_FIELD, 1).try_cast("double"), F.lit(0.5))
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    pattern = words(PATTERN_FIELD)
    return responses.withColumns({
        "riskScore": risk, "confidence": risk,
        "reasoning": words(REASONING_FIELD),
        "recommendation": words(RECOMMENDATION_FIELD),
        "pattern": F.when(pattern == "", "unknown").otherwise(pattern),
    })
