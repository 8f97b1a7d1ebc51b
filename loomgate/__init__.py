"""A Spark-native engine for document retrieval, governance and analytics."""
