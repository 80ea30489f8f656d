"""Operators for large-scale training-data preparation, each a set of Spark jobs."""
