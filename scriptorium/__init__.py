"""Scriptorium: a PySpark-native document-analytics and hybrid-retrieval engine."""

__version__ = "0.2.0"
