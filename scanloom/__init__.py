"""Scan-loop analytics on PySpark."""
