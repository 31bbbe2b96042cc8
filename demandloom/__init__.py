"""Spark-native demand analytics: ingestion, validation, features, forecasts and scoring of retail demand panels."""
