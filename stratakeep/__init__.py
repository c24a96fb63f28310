"""Snapshot catalogues of immutable data parts, as Spark DataFrames."""
