"""Preference-data building and contract evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
