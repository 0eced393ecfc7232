"""Hand-computed scoring fixtures."""

import datetime as dt
import json

AT = dt.datetime(2026, 7, 4, 13, 0)


def txn(i, customer, amount, merchant, category, location, device, channel, rapid, at=AT):
    return (f"TEST-{i:03d}", customer, float(amount), "USD", merchant, category, location, at,
            (device, channel, rapid, None, None))


FRAUD = (*txn(1, "CUST-001", 30, "MERCHANT-SUSPICIOUS-7", "ONLINE", "Unknown Location", "BOT-DEVICE-1", "ONLINE", True),
         ("CUST-001", 244.0, 1000.0, ["GROCERY", "ONLINE"], "Houston", "HIGH"), 15)
CLEAR = (*txn(2, "CUST-002", 48, "GROCERY-STORE-1", "GROCERY", "Houston", "DEVICE-NORMAL-1", "IN_STORE", False),
         ("CUST-002", 178.0, 500.0, ["GROCERY", "RESTAURANT"], "Houston", "LOW"), 1)
UNKNOWN = (*txn(3, "CUST-UNKNOWN", 500, "MERCHANT-SUSPICIOUS-1", "ONLINE", "Unknown Location", "BOT-DEVICE-2", "ONLINE",
                True), None, 8)

# Values of the nineteen features, in order.
EXPECTED = {
    "TEST-001": [0.1230, 0.03, 0, 15, 225, 1, 1, 0, 0, 1, 1, 1, 13, 0, 1, 1, 0, 1, 1],
    "TEST-002": [0.2697, 0.096, 0, 1, 1, 0, 0, 1, 0, 0, 1, 0, 13, 0, 1, 0, 1, 0, 0],
    "TEST-003": [5.0, 0.5, 1, 8, 64, 1, 1, 0, 0, 1, 0, 1, 13, 0, 1, 0, 0, 1, 1],
}


def enriched(spark, rows=(FRAUD, CLEAR, UNKNOWN)):
    from pyspark.sql import types as T

    from riskloom import schemas

    schema = T.StructType([*schemas.TRANSACTION.fields, T.StructField("profile", schemas.PROFILE),
                           T.StructField("velocityCount", T.LongType())])
    return spark.createDataFrame(list(rows), schema)


def message(i, customer, at, **changes):
    body = {"transactionId": f"T-{i:03d}", "customerId": customer, "amount": 20.0, "currency": "USD",
            "merchantId": "MERCHANT-1", "merchantCategory": "ONLINE", "location": "Houston", "timestamp": at,
            "metadata": {"deviceId": "DEVICE-1", "channel": "ONLINE", "rapidFire": False}}
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v is not None})
