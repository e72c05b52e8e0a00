"""Spark-native analytics over versioned folder trees."""
