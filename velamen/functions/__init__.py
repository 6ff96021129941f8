"""Column expressions: text forms, checks and the fixed vocabulary."""
