"""Subpackage functions of the annalist engine."""
