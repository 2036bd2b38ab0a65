"""Spark-native reversible pseudonymisation of text and tabular data."""
