"""Subpackage operators of the annalist engine."""
