"""Spark-native operators for building, judging and analysing text corpora."""
