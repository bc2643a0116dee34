"""Spark-native operators for species-observation tables (see README.md)."""
