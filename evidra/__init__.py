"""A Spark-native engine for evidence analytics over text corpora."""
