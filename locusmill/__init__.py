"""Spark-first analytics for sparse, ambiguous assignment data."""
