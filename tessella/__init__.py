"""A PySpark-native engine for similarity, retrieval and corpus analytics."""
