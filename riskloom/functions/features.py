"""The nineteen risk features as stateless column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.functions.numbers import rounded_sql


# Reading the profile, with the defaults of a customer that has none.
AVERAGE = f"IF(profile IS NULL, {S.DEFAULT_AVERAGE}D, profile.averageTransactionAmount)"
LIMIT = f"IF(profile IS NULL, {S.DEFAULT_LIMIT}D, profile.dailySpendingLimit)"
RISK = f"IF(profile IS NULL, '{S.DEFAULT_RISK}', profile.riskLevel)"
HOME = "IF(profile IS NULL, '', profile.primaryLocation)"
# A missing or zero count reads as one transaction.
VELOCITY = "CAST(coalesce(nullif(velocityCount, 0), 1) AS BIGINT)"


def has_profile() -> Column:
    return F.col("profile").isNotNull()


def risk_level() -> Column:
    return F.expr(RISK)


def _flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INT)"


def feature_columns(high_velocity: int = S.HIGH_VELOCITY) -> dict[str, Column]:
    """Feature name to expression over a frame of transaction, profile, velocityCount."""
    unknown = "contains(lower(location), 'unknown')"
    at_home = f"lower(location) = lower({HOME})"
    definitions = {
        "amount_ratio": rounded_sql(f"IF({AVERAGE} > 0, try_divide(amount, {AVERAGE}), 1D)", 4),
        "daily_limit_ratio": rounded_sql(f"IF({LIMIT} > 0, try_divide(amount, {LIMIT}), 0D)", 4),
        "is_amount_unusual": _flag(f"amount > {AVERAGE} * {S.UNUSUAL_MULTIPLE}"),
        "velocity_count": VELOCITY,
        "velocity_squared": f"{VELOCITY} * {VELOCITY}",
        "is_high_velocity": _flag(f"{VELOCITY} >= {int(high_velocity)}"),
        "is_unknown_location": _flag(unknown),
        "is_primary_location": _flag(at_home),
        "is_different_city": _flag(f"NOT ({at_home}) AND NOT {unknown}"),
        "is_online": _flag("merchantCategory = 'ONLINE'"),
        "is_typical_category": _flag("array_contains(profile.transactionCategories, merchantCategory)"),
        "is_suspicious_merchant": _flag("contains(lower(merchantId), 'suspicious')"),
        "hour": "hour(timestamp)",
        "is_off_hours": _flag("hour(timestamp) < 6 OR hour(timestamp) >= 22"),
        "is_weekend": _flag("weekday(timestamp) >= 5"),
        "is_high_risk_customer": _flag(f"{RISK} = 'HIGH'"),
        "is_low_risk_customer": _flag(f"{RISK} = 'LOW'"),
        "is_bot_device": _flag("contains(lower(metadata.deviceId), 'bot')"),
        "is_rapid_fire": _flag("metadata.rapidFire"),
    }
    return {name: F.expr(text) for name, text in definitions.items()}


def with_features(enriched: DataFrame, high_velocity: int = S.HIGH_VELOCITY) -> DataFrame:
    """Append the features; the plan stays one codegen projection."""
    return enriched.withColumns(feature_columns(high_velocity))


def feature_map() -> Column:
    """All features as ``map<string,double>`` (the open map carried on predictions)."""
    entries = [part for name in S.FEATURES for part in (F.lit(name), F.col(name).cast("double"))]
    return F.create_map(*entries)

# What a case text assumes when a feature is missing from the map.
MISSING_FEATURE = {"velocity_count": 1.0, "amount_ratio": 1.0, "hour": 12.0}
_REAL = ("amount_ratio", "daily_limit_ratio")


def from_feature_map(df: DataFrame, column: str = "featuresUsed") -> DataFrame:
    """Feature columns back from the open map of a decoded prediction."""
    def read(name: str) -> Column:
        value = F.coalesce(F.try_element_at(column, F.lit(name)), F.lit(MISSING_FEATURE.get(name, 0.0)))
        return value if name in _REAL else value.cast("long")

    return df.withColumns({name: read(name) for name in S.FEATURES})
