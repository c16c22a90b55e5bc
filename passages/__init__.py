"""Spark-native passage retrieval, its evaluation, and the tables around it."""
