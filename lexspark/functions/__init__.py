"""Column expressions and their Python twins."""
