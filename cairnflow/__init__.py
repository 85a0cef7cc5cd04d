"""Incremental ingestion, normalisation and analysis of sensor samples on Spark."""
