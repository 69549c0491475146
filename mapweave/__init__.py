"""Spark-native analytics over catalogues of map services."""
