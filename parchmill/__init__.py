"""Spark-native document question-answering analytics."""
