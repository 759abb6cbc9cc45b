"""siltworks: Spark-native preparation of machine-learning data."""
