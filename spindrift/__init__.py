"""Spark-native analytics for multi-run time series, event tables and text corpora."""
