"""Scriptorium: analytics over annotated scholarly documents, on Spark DataFrames."""

__version__ = "0.1.0"
