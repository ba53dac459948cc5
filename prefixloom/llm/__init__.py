"""Operators of a training-data pipeline over documents, pages and benchmark items.

Nothing else in the library imports this subpackage. Each operator module has a general
interface; ``queries`` derives the registered ``opN_`` queries from them.
"""
