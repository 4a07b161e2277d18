"""Spark-native drift, quality and recovery engine for pairs of dataset snapshots."""
