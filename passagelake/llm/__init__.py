"""Operators for preparing large text corpora for model training.

Every operator takes and returns DataFrames, states its result for nulls, empty
texts, ties and repeated rows in its docstring, and keeps intermediate tables
in the folder that ``spark.checkpoint.dir`` names (see :mod:`.scratch`).
Nothing else in the library imports this subpackage.
"""
