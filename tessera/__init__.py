"""Spark-native analytics over measurement tables, event logs and array-valued signals."""
