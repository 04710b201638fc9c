"""Spark-native search and corpus analytics engine."""
