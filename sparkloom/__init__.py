"""A PySpark-native document search and analytics engine."""
