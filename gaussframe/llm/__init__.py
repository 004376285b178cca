"""Operators for training-data pipelines over text tables (documents, labels).

Every module holds one operator with a general interface; ``queries`` derives the fixed digest
columns of the registered queries from them.  Nothing outside this package imports it.
"""
