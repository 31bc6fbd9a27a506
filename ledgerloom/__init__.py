"""Spark-native tracking of records that arrive in incremental, semi-structured batches."""
