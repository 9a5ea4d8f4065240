"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
holds the registered queries and their SQL. Nothing outside this subpackage
imports it, except the guarded lookup in ``__spark_entry__.py``.
"""
