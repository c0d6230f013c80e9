"""Relational operators: dedup, splits, graphs, metrics."""
