"""Operators for building language-model training data.

Nothing else in the library imports this subpackage: it can be deleted and the
search engine keeps working.  ``queries.py`` and ``oracles.py`` hold the thin
queries and their SQL.
"""
