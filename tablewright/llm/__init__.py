"""Operators for preparing language-model training data.

One module per operator; ``queries`` holds the registered queries and their
DuckDB SQL. Nothing outside this package imports it except the guarded lines
in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
