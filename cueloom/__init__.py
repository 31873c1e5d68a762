"""Timed-transcript analytics expressed as PySpark DataFrame operations."""
