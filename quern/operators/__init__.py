"""Operators over DataFrames of documents, chunks, queries and ranks."""
