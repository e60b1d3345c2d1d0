"""Operators for training-data pipelines: joins, scans, packing, indexes.

Nothing else in the package imports this subpackage.
"""
