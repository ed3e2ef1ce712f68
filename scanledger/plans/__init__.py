"""Compositions of operators: whole jobs as one DataFrame or one bundle of DataFrames."""
