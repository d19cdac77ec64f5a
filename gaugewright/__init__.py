"""A Spark-native engine for test-coverage and code-quality analytics."""
