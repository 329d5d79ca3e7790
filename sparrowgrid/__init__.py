"""Spark-native research engine on long return panels."""
