"""Operators for preparing training text on Spark. Nothing outside this package imports it."""
