"""Operators for preparing training corpora.

Every operator takes DataFrames and column names and returns a DataFrame.
Nothing outside this subpackage imports it.
"""
