"""Column expressions: no joins, no shuffles, no Python in the row path."""
