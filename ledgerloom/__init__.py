"""Spark-native document analytics: relational, retrieval, number and evaluation operators over DataFrames."""
