"""Spark-native operators for civic field-operations data."""
