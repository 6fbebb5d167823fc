"""A Spark-native engine for streams of articles, posts and sensor events."""
