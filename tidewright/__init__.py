"""Tidewright: a Spark-first warehouse and training-data engine."""
