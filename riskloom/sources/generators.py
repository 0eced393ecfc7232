"""Synthetic profiles, transactions and training rows, made by Spark from ranges.

Every value is a function of the row number and the seed, so any partition
can be made again on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import settings as S

# Vocabularies and ranges of the generated data.
CITIES = ["New York", "Los Angeles", "Chicago", "Houston", "Phoenix"]
CATEGORIES = ["GROCERY", "GAS_STATION", "RESTAURANT", "RETAIL", "ONLINE"]
RISKS = ["LOW", "MEDIUM", "HIGH"]
SCENARIOS = {"normal": 3, "rapid": 15, "unusual": 5, "mixed": 21}
START = "2026-07-04 13:00:00"


def unit(seed: int, tag: str, row: str = "id") -> Column:
    """A repeatable draw in [0, 1) for this row."""
    return F.pmod(F.xxhash64(F.col(row), F.lit(tag), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def below(limit: int, seed: int, tag: str) -> Column:
    return F.floor(unit(seed, tag) * limit).cast("int")


def choice(values: list[str], seed: int, tag: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), below(len(values), seed, tag) + 1)


def generate_profiles(spark: SparkSession, n: int, seed: int = 42, risks: list[str] = RISKS) -> DataFrame:
    rows = spark.range(1, n + 1)
    return rows.select(
        F.format_string("CUST-%03d", "id").alias("customerId"),
        (below(450, seed, "average") + 50).cast("double").alias("averageTransactionAmount"),
        (below(4000, seed, "limit") + 1000).cast("double").alias("dailySpendingLimit"),
        F.array(choice(CATEGORIES, seed, "first"), choice(CATEGORIES, seed, "second")).alias("transactionCategories"),
        choice(CITIES, seed, "city").alias("primaryLocation"),
        choice(risks, seed, "risk").alias("riskLevel"),
    )


def _scenario(scenario: str, seed: int) -> tuple[Column, Column]:
    """(kind, milliseconds since the start) for each row number."""
    row = F.col("id")
    if scenario == "continuous":
        draw = below(100, seed, "kind")
        kind = F.when(draw < 80, "normal").when(draw < 90, "rapid").otherwise("unusual")
        return kind, row * 1250 + below(1250, seed, "pause")
    if scenario == "mixed":
        kind = F.when(row < 5, "normal").when(row < 13, "rapid").when(row < 18, "normal").otherwise("unusual")
        offset = (
            F.when(row < 5, row * 1000).when(row < 13, (row - 5) * 200 + 5000)
            .when(row < 18, (row - 13) * 1000 + 6600).otherwise((row - 18) * 2000 + 11600))
        return kind, offset
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario}")
    return F.lit(scenario), row * {"normal": 1000, "rapid": 200, "unusual": 2000}[scenario]


def generate_transactions(spark: SparkSession, scenario: str, profiles: DataFrame, n_profiles: int,
                          n: int | None = None, seed: int = 42) -> DataFrame:
    """``n`` transactions of a scenario over generated profiles (``CUST-001`` on).

    Attack rows all hit one customer (the first, or the second for the mixed
    scenario's unusual amounts); other rows spread over the profiles.
    """
    rows = spark.range(SCENARIOS.get(scenario, 100) if n is None else n)
    return transactions_for(rows, scenario, profiles, n_profiles, seed)


def stream_transactions(spark: SparkSession, profiles: DataFrame, n_profiles: int, rows_per_second: int = 1,
                        seed: int = 42) -> DataFrame:
    """The continuous scenario as an unbounded stream from the ``rate`` source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    rows = ticks.select(F.col("value").alias("id"))
    return transactions_for(rows, "continuous", profiles, n_profiles, seed)


def transactions_for(rows: DataFrame, scenario: str, profiles: DataFrame, n_profiles: int, seed: int) -> DataFrame:
    kind, offset = _scenario(scenario, seed)
    fixed = F.when(F.col("kind") == "rapid", 1).when(F.col("kind") == "unusual", 2 if scenario == "mixed" else 1)
    spread = below(n_profiles, seed, "customer") + 1
    number = spread if scenario == "continuous" else F.coalesce(fixed, spread)
    moment = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=(offset / 1000).cast("decimal(18,6)"))
    drawn = rows.withColumns({"kind": kind, "moment": moment}).withColumn(
        "customer", F.format_string("CUST-%03d", number))
    known = profiles.select(F.col("customerId").alias("customer"), "averageTransactionAmount",
                            "transactionCategories", "primaryLocation")
    joined = drawn.join(known, "customer")
    rapid, unusual = F.col("kind") == "rapid", F.col("kind") == "unusual"
    average = F.col("averageTransactionAmount")
    prefix = F.when(rapid, "TXN-RAPID-").when(unusual, "TXN-UNUSUAL-").otherwise("TXN-")
    return joined.select(
        F.concat(prefix, F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(seed))), 1, 16)).alias("transactionId"),
        F.col("customer").alias("customerId"),
        F.round(F.when(rapid, below(50, seed, "small") + 10).when(unusual, average * 5)
                .otherwise(average * (unit(seed, "amount") + 0.5)), 2).alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(rapid, F.concat(F.lit("MERCHANT-SUSPICIOUS-"), below(10, seed, "merchant").cast("string")))
        .when(unusual, F.concat(F.lit("MERCHANT-LUXURY-"), below(10, seed, "merchant").cast("string")))
        .otherwise(F.concat(F.lit("MERCHANT-"), below(1000, seed, "merchant").cast("string"))).alias("merchantId"),
        F.when(rapid, "ONLINE").when(unusual, "LUXURY_GOODS")
        .otherwise(F.element_at("transactionCategories", below(2, seed, "category") + 1)).alias("merchantCategory"),
        F.when(rapid, "Unknown Location").when(unusual, "Different Location")
        .otherwise(F.col("primaryLocation")).alias("location"),
        F.col("moment").alias("timestamp"),
        F.struct(
            F.when(rapid, F.concat(F.lit("BOT-DEVICE-"), below(5, seed, "device").cast("string")))
            .when(unusual, "UNKNOWN-DEVICE")
            .otherwise(F.concat(F.lit("DEVICE-"), below(100, seed, "device").cast("string"))).alias("deviceId"),
            F.lit("ONLINE").alias("channel"),
            F.when(rapid, True).alias("rapidFire"),
            F.when(rapid, F.col("id").cast("int")).alias("sequence"),
            F.when(unusual, True).alias("unusualAmount"),
        ).alias("metadata"),
    )


# The training distributions. A pair is a uniform range, a
# whole-number pair in a list is a half-open integer range, a single number
# is the chance of 1, and None is a constant 0.
NORMAL = {
    "amount_ratio": (0.3, 1.8), "daily_limit_ratio": (0.01, 0.3), "is_amount_unusual": 0.08,
    "velocity_count": [1, 3], "is_high_velocity": None, "is_unknown_location": 0.1, "is_primary_location": 0.8,
    "is_different_city": 0.1, "is_online": 0.5, "is_typical_category": 0.85, "is_suspicious_merchant": 0.05,
    "hour": [8, 22], "is_off_hours": None, "is_weekend": 0.5, "is_high_risk_customer": 0.15,
    "is_low_risk_customer": 0.85, "is_bot_device": 0.03, "is_rapid_fire": 0.03,
}
VELOCITY = {
    "amount_ratio": (0.05, 0.3), "daily_limit_ratio": (0.01, 0.1), "is_amount_unusual": 0.6,
    "velocity_count": [5, 15], "is_high_velocity": 1.0, "is_unknown_location": 0.7, "is_primary_location": 0.25,
    "is_different_city": 0.6, "is_online": 1.0, "is_typical_category": 0.25, "is_suspicious_merchant": 0.8,
    "hour": [0, 24], "is_off_hours": 0.5, "is_weekend": 0.5, "is_high_risk_customer": 0.7,
    "is_low_risk_customer": 0.2, "is_bot_device": 0.8, "is_rapid_fire": 0.85,
}
UNUSUAL = {
    "amount_ratio": (4.0, 10.0), "daily_limit_ratio": (0.5, 1.5), "is_amount_unusual": 1.0,
    "velocity_count": [1, 4], "is_high_velocity": None, "is_unknown_location": 0.5, "is_primary_location": None,
    "is_different_city": 0.65, "is_online": 1.0, "is_typical_category": 0.3, "is_suspicious_merchant": 0.5,
    "hour": [0, 24], "is_off_hours": 0.5, "is_weekend": 0.5, "is_high_risk_customer": 0.7,
    "is_low_risk_customer": 0.2, "is_bot_device": 0.4, "is_rapid_fire": 0.3,
}


def _draw(spec, seed: int, tag: str) -> Column:
    if spec is None:
        return F.lit(0).cast("double")
    value = unit(seed, tag)
    if isinstance(spec, tuple):
        return value * (spec[1] - spec[0]) + spec[0]
    if isinstance(spec, list):
        return F.floor(value * (spec[1] - spec[0]) + spec[0]).cast("double")
    return (value < spec).cast("double")


def _class_rows(spark: SparkSession, first: int, count: int, spec: dict, label: int, seed: int) -> DataFrame:
    rows = spark.range(first, first + count)
    drawn = rows.select("id", *[_draw(s, seed, name).alias(name) for name, s in spec.items()])
    squared = drawn.withColumn("velocity_squared", F.col("velocity_count") * F.col("velocity_count"))
    return squared.select("id", *S.FEATURES, F.lit(label).alias("label"))


def generate_training_set(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """80 % normal, 10 % velocity attacks, 10 % unusual amounts; velocity_squared is the square."""
    normal, attack = n * 8 // 10, n // 10
    return (
        _class_rows(spark, 0, normal, NORMAL, 0, seed)
        .unionAll(_class_rows(spark, normal, attack, VELOCITY, 1, seed))
        .unionAll(_class_rows(spark, normal + attack, attack, UNUSUAL, 1, seed))
    )
