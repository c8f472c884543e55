"""Docketry: retrieval analytics over dated, citable documents, on PySpark."""

__version__ = "0.1.0"
