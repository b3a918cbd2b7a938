"""Retrieval, evaluation and attribution as set-based PySpark plans."""
