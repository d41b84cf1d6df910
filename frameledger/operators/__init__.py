"""Operators for large tables of records; each takes and returns DataFrames."""
