"""Operators for large training-data pipelines.

Nothing else in the library imports this package; the driver entry adds its
queries only when the package is present.
"""
