"""The index as a set of lazy DataFrames, and the queries over it."""
