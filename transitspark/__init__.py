"""Spark jobs that find and characterise periodic dips in time-series photometry."""
