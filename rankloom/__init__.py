"""Rankloom: a Spark-native engine for building and scoring document-retrieval pipelines."""
