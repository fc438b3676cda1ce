"""Column expressions that operators are made of."""
