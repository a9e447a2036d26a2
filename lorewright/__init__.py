"""Spark-native knowledge-base analytics: retrieval, graph, metrics, rules and governance over DataFrames."""
