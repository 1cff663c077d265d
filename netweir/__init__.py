"""Spark-native traffic analytics engine."""
