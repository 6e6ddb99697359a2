"""Spark-first analytics over append-only observation logs."""

__version__ = "0.1.0"
