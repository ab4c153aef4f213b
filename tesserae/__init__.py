"""Spark-first analytics for multi-label image classification tables."""
