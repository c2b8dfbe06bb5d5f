"""A PySpark engine for point-in-time time-series research."""
