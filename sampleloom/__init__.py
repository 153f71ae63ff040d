"""Spark-native analytics for audio and other sampled time series."""

__version__ = "0.1.0"
