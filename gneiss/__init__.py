"""Corpus analytics, retrieval and graph operators on PySpark DataFrames."""
