"""Streaming payment-risk analytics expressed as Spark DataFrame jobs."""
