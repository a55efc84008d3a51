"""lorespark: a PySpark-native engine for knowledge-base search and catalogue analytics."""

__version__ = "0.1.0"
