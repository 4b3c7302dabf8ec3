"""Subpackage streaming of the annalist engine."""
