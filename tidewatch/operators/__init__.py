"""Operators of the detection engine; each takes and returns DataFrames."""
