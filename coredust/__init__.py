"""Spark-native analytics over captured memory images, and operators for language-model corpora."""
