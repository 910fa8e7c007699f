"""foliospark: a PySpark-native engine for corpora of scientific papers."""

__version__ = "0.1.0"
