"""Spark-native analytics for text corpora: DataFrame in, DataFrame out."""
