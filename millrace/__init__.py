"""Spark-native analytics over log-structured queues, and pipelines of training data."""
