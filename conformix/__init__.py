"""Spark-native API parity analytics."""
