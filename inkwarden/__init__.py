"""Spark-native document intelligence and redaction."""
