"""Column expressions: scalars, text and vectors."""
