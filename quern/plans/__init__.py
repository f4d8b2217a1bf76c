"""Composite plans: retrieval from query to answer, experiments, and the catalogue of queries."""
