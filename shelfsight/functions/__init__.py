"""Column expressions and small join helpers shared by the operators."""
