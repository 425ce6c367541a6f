"""Spark-native evaluation and training-data curation engine."""
