"""Timed-text and interval analytics as plain Spark DataFrame operators."""
