"""Operators for preparing text and vector training data on Spark; nothing else in the library imports this package."""
