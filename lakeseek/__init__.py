"""lakeseek: a Spark-native engine for document retrieval and corpus preparation."""

__version__ = "0.1.0"
