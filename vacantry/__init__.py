"""Postings analytics on PySpark: every operator is a function from DataFrames to DataFrames."""
