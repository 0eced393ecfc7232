"""Record schemas. Readers always pass one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STR, DBL, LNG, INT, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
NTZ = T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)

METADATA = _struct(deviceId=STR, channel=STR, rapidFire=BOOL, sequence=INT, unusualAmount=BOOL)

TRANSACTION = _struct(
    transactionId=STR, customerId=STR, amount=DBL, currency=STR, merchantId=STR,
    merchantCategory=STR, location=STR, timestamp=NTZ, metadata=METADATA,
)

PROFILE = _struct(
    customerId=STR, averageTransactionAmount=DBL, dailySpendingLimit=DBL,
    transactionCategories=T.ArrayType(STR), primaryLocation=STR, riskLevel=STR,
)

ENRICHED = _struct(transaction=TRANSACTION, customerProfile=PROFILE, velocityCount=LNG)

INSIGHT = _struct(
    agentType=STR, agentName=STR, analysis=STR, riskScore=DBL, confidence=DBL,
    reasoning=STR, recommendation=STR, timestamp=NTZ,
)

DECISION = _struct(
    transactionId=STR, isFraudulent=BOOL, confidenceScore=DBL, primaryReason=STR,
    detailedExplanation=STR, agentInsights=T.ArrayType(INSIGHT),
    riskFactors=T.MapType(STR, DBL), analyzedAt=NTZ, fraudPattern=STR,
)

CONTEXT_CASE = _struct(similarity=DBL, fraudPattern=STR, confidence=DBL, confirmedBy=STR, summary=STR)
CONTEXT = _struct(casesFound=INT, cases=T.ArrayType(CONTEXT_CASE), promptContext=STR)

PREDICTION = _struct(
    transactionId=STR, customerId=STR, mlFraudScore=DBL, lstmSequenceScore=DBL,
    combinedScore=DBL, modelVersion=STR, shapExplanation=T.MapType(STR, DBL),
    featuresUsed=T.MapType(STR, DBL), ragContext=CONTEXT, inferenceLatencyMs=LNG, timestamp=NTZ,
)

FEEDBACK = _struct(
    transactionId=STR, predictedFraud=BOOL, actualFraud=BOOL, confidence=DBL,
    agentConsensus=INT, fraudPattern=STR, source=STR, timestamp=LNG,
    analystId=STR, reviewTimeSeconds=INT, mlFraudScore=DBL,
)

CASE_METADATA = _struct(
    transactionId=STR, customerId=STR, fraudPattern=STR, confidence=DBL, mlFraudScore=DBL,
    velocityCount=INT, isHighVelocity=INT, isBotDevice=INT, isSuspiciousMerchant=INT,
    confirmedBy=STR, embeddedAt=STR,
)
CASE = _struct(id=STR, document=STR, embedding=T.ArrayType(T.FloatType()), metadata=CASE_METADATA)

ATTRIBUTION = T.ArrayType(_struct(feature=STR, value=DBL))

AUDIT = {
    "transactions": _struct(
        transaction_id=STR, customer_id=STR, amount=MONEY, merchant_id=STR, merchant_category=STR,
        location=STR, device_id=STR, timestamp=NTZ, created_at=NTZ, velocity_5min=INT,
        avg_transaction_amount=MONEY, account_age_days=INT,
    ),
    "customers": _struct(
        customer_id=STR, avg_transaction_amount=MONEY, typical_merchant_category=STR,
        account_age_days=INT, risk_score=T.DecimalType(5, 2), total_transactions=INT,
        total_fraud_cases=INT, last_transaction_at=NTZ, last_updated=NTZ, version=INT,
    ),
    "fraud_decisions": _struct(
        id=LNG, transaction_id=STR, ml_score=T.DecimalType(5, 4), ml_model_type=STR,
        shap_top_features=ATTRIBUTION, llm_confidence=T.DecimalType(5, 2), fraud_pattern=STR,
        reasoning=STR, recommendation=STR, rag_context_used=BOOL,
        rag_similarity_score=T.DecimalType(5, 4), rag_cases_retrieved=INT, decision=STR, decided_at=NTZ,
    ),
    "case_reviews": _struct(
        id=LNG, transaction_id=STR, analyst_id=STR, review_outcome=STR, notes=STR,
        time_to_review_seconds=INT, reviewed_at=NTZ, fraud_decision_id=LNG,
        evidence_sources=_struct(fraudPattern=STR, predictedFraud=BOOL, actualFraud=BOOL, confidence=DBL),
        confidence_level=STR,
    ),
    "model_predictions": _struct(
        id=LNG, transaction_id=STR, model_type=STR, prediction_score=T.DecimalType(5, 4),
        top_features=ATTRIBUTION, prediction_time_ms=INT, predicted_at=NTZ, model_version=STR,
        actual_label=BOOL, prediction_correct=BOOL, updated_at=NTZ,
    ),
    "feature_stats": _struct(
        id=LNG, feature_name=STR, stat_type=STR, stat_value=T.DecimalType(12, 4), sample_count=INT,
        window_start=NTZ, window_end=NTZ, computed_at=NTZ,
    ),
}
