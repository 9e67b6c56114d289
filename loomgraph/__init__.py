"""A Spark-native engine for code graphs."""
