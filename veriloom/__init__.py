"""Spark-native profiling, cleaning, retrieval, modelling and evaluation."""
