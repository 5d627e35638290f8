"""Retrieval analytics over text and source code as PySpark DataFrames."""
