"""Column-level functions that return Columns."""
