"""Spark-native code-intelligence and graph analytics."""
