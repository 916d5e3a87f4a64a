"""A Spark-native engine for structured legal-text corpora."""
