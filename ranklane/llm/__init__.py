"""Operators for preparing training data from large document collections.

Nothing else in the library imports this subpackage.
"""
