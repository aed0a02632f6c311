"""Exact text retrieval and bulk text-data operators on PySpark DataFrames."""

__version__ = "0.1.0"
