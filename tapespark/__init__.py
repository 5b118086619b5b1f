"""PySpark-native analytics for market-microstructure event data."""

__version__ = "0.1.0"
