"""Tidewater: a Spark-native engine for curating and evaluating text corpora."""

__version__ = "0.1.0"
