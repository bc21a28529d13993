"""Hourly electricity analytics on Spark: medallion tables, rollups, features and models."""
