"""Spark-native vector and retrieval analytics, with training-data operators beside it."""
