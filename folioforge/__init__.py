"""A PySpark-native analytics and retrieval engine for document collections."""
