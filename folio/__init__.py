"""folio: a Spark-native engine for citable document retrieval and text data processing."""

__version__ = "0.1.0"
