"""Spark-native point-in-time panel analytics."""
