"""Operators for building training data from text at scale.

Nothing else in the library imports this package; ``__spark_entry__`` adds
``QUERIES`` and ``ORACLE_SQL`` when it is present.
"""
