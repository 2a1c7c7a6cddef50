"""Scalar functions as Spark columns: decimals, canonical forms, keys, calendars and search text."""
