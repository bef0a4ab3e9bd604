"""Operators for preparing training corpora at scale.

Every operator is a function from DataFrames to a DataFrame; the thin queries
that apply them to whole tables are in :mod:`graphloom.llm.queries`.
"""
