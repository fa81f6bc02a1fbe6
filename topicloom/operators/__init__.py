"""Spark operators."""
