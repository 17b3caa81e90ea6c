"""Corpus-preparation operators for training data.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
Every operator takes DataFrames and column names and returns DataFrames; the registered
queries are in :mod:`knotwork.llm.queries`.
"""
