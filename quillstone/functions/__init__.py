"""Column expressions that the table jobs are made of."""
