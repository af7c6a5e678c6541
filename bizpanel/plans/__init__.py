"""Reports: each function returns one DataFrame or a dict of named DataFrames."""
