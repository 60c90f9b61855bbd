"""Column expressions: row-level derivations and arithmetic on vectors."""
