"""Lectern: evidence search over book-length text as PySpark DataFrame pipelines."""
