"""Operators on DataFrames: search, vectors, parsing, chunking, registry, embedding."""
