"""Operators for preparing training data: extraction, filtering, near duplicates, mixing.

Nothing else in the library imports this subpackage.
"""
