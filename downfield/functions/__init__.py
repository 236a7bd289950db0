"""Column expressions and grouping helpers shared by the operators."""
