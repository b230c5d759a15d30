"""Spark-first catalogue analytics engine: scans, filters, joins, roll-ups, preference models and streams as DataFrame plans."""

__version__ = "0.1.0"
