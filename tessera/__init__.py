"""Tessera: a Spark-native code-intelligence, retrieval and corpus engine."""
