"""Trace, statistics and LSM-catalog analytics as ordinary PySpark DataFrames."""
