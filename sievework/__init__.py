"""sievework: a Spark-native engine for web-search data processing."""

__version__ = "0.1.0"
