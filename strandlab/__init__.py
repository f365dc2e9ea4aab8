"""strandlab: a Spark-native analytics engine for transfer-learning experiments over text and sequences."""
