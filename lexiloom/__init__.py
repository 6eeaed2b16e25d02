"""A Spark-native engine for searching chunked text and source code."""
