"""quarry: Spark-native corpus preparation and retrieval."""
