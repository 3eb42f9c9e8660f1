"""Toll-transaction analytics as plain PySpark DataFrame functions."""
