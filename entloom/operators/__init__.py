"""Operators from documents to scored clusters; each takes and returns DataFrames."""
