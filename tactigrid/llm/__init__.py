"""Operators for training-data pipelines over documents, pages, vectors and conversations.

Nothing outside this subpackage imports it. `registry` lists the queries.
"""
