"""Stages, benchmark and the query catalogue."""
