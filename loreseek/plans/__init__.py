"""Whole plans: search, indexing, evaluation, and the registered queries."""
