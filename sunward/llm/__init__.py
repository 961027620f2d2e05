"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames, selects the columns it needs by name (so extra columns never clash), accepts
NULL in any column, and states in its docstring what a NULL, an empty table, a tie or a
repeated row gives.
"""
