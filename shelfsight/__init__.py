"""Retail analytics as plain Spark DataFrame transformations."""
