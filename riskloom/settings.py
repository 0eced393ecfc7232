"""Thresholds and names shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds of the decision rules.
HIGH_VELOCITY = 3
VELOCITY_ALERT = 3
UNUSUAL_MULTIPLE = 3
FRAUD_RISK = 0.6
DISAGREEMENT = 0.4
ALERT_CONFIDENCE = 0.8
REVIEW_LOW = 0.3
REVIEW_HIGH = 0.7
MIN_SIMILARITY = 0.40
MIN_EMBED_CONFIDENCE = 0.70
COLD_START_VELOCITY = 2
COLD_START_SCORE = 0.1
PAIRING_SECONDS = 300
FEED_SIZE = 100

# Defaults used when a customer has no profile.
DEFAULT_AVERAGE = 100.0
DEFAULT_LIMIT = 1000.0
DEFAULT_RISK = "UNKNOWN"

# The feature vector, in its contractual order.
FEATURES = [
    "amount_ratio",
    "daily_limit_ratio",
    "is_amount_unusual",
    "velocity_count",
    "velocity_squared",
    "is_high_velocity",
    "is_unknown_location",
    "is_primary_location",
    "is_different_city",
    "is_online",
    "is_typical_category",
    "is_suspicious_merchant",
    "hour",
    "is_off_hours",
    "is_weekend",
    "is_high_risk_customer",
    "is_low_risk_customer",
    "is_bot_device",
    "is_rapid_fire",
]

# Output names of the three-way split and of the streams.
ROUTES = ["fraud-alerts", "human-review", "approved-transactions"]
PATTERNS = ["card_testing", "vpn_bot_fraud", "account_takeover", "general_fraud"]


@dataclass(frozen=True)
class Retrieval:
    """How many similar cases to fetch, keep and accept."""

    keep: int = 3
    threshold: float = MIN_SIMILARITY

    @property
    def fetch(self) -> int:
        return max(self.keep * 4, 20)
