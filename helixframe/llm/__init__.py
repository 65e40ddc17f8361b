"""Operators of a training-data pipeline over text corpora.

Every operator takes and returns DataFrames.  Thin ``opN_*`` queries over the
tables are in :mod:`helixframe.llm.queries`; nothing else in the library
imports this subpackage.
"""
