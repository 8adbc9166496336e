"""Column expressions: text and vector functions."""
