"""Operational time-series analytics as PySpark DataFrame operators."""
