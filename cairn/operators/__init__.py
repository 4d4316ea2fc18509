"""Relational operators over image tables, as functions of DataFrames."""
