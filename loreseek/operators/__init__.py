"""Operators: registry statements, vector and keyword search, chunks with fallback, walks, evaluation."""
