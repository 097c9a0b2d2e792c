"""Column expressions and fixed tables."""
