"""Training-data operators: filtering, deduplication, formatting and encoding.

Every operator here takes DataFrames and returns DataFrames. Nothing else in
the library imports this subpackage.
"""
