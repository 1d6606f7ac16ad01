"""A PySpark-native engine for curating streams of articles and reader interactions."""
