"""Spark-native code intelligence, retrieval analytics and corpus processing."""
