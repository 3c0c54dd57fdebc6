"""Spark-native analytics over genomic interval data."""
