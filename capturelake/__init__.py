"""Spark-native analysis of JVM diagnostic captures."""
