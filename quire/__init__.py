"""quire: a Spark-native engine for long-form text corpora."""
