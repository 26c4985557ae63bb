"""Operators for large training-data pipelines.

Nothing else in rillflow imports this subpackage.
"""
