"""Spark-native document, table and text analytics engine."""
