"""Operators for preparing training data: texts, pages, vectors and token files.

Nothing else in the library imports this subpackage.
"""
