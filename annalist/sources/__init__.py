"""Subpackage sources of the annalist engine."""
