"""Spark jobs for panel time-series research on OHLCV bars."""
