"""Spark-native nearest-neighbour analytics over embedding tables."""
