"""Retail line-item analytics as composable PySpark DataFrame functions."""

__version__ = "0.1.0"
