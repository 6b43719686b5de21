"""Spark-native user-behaviour risk analytics."""
