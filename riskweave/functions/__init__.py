"""Spark-first building blocks of the filing-text engine."""
