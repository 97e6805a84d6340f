"""Spark-native repetition analytics over tables of texts."""
