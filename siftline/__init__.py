"""siftline: a PySpark-native analytics engine for security data."""

__version__ = "0.1.0"
