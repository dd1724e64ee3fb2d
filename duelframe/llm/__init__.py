"""Operators of a training-data pipeline over tables of documents.

Nothing else in the package imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` derives the registered
queries from them.
"""
