"""Spark-native engine that finds, scores, consolidates and masks sensitive values in text corpora."""
