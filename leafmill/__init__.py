"""leafmill: a PySpark-native engine for document collections."""
