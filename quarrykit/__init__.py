"""Spark-native curation and evaluation engine for image-text training corpora."""
