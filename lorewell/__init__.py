"""Spark-native analytics over documents, session logs and agent memory."""
