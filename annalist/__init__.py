"""Annalist: a PySpark-native analytics engine for facts that hold for a time."""

__version__ = "0.1.0"
