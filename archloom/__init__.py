"""archloom: a Spark-native engine for web-archive records."""

__version__ = "0.1.0"
