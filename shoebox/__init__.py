"""Spark-first analytics over media indexes."""
