"""Quadrat: Spark-native planning and evaluation of geographic experiments."""
