"""Spark-native analytics for the wrong answers of a language model that readers are least likely to notice."""
