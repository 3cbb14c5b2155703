"""millrace: a Spark-native engine for catalogue search, ingest and training-data preparation."""

__version__ = "0.1.0"
