"""Spark-first analytics for reliability decisions and text data sets."""
