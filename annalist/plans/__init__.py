"""Subpackage plans of the annalist engine."""
