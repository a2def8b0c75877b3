"""Spark-first data-quality engine for object-detection image datasets."""
