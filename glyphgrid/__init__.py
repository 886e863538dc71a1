"""Spark-native analytics over annotated images and text."""
