"""Foliant: a Spark-native engine for corpora of scientific literature."""

__version__ = "0.1.0"
