"""Operators that large training-data pipelines need. Nothing else in the library imports this package."""
