"""Column expressions: cleaning, calendar labels, guarded changes, tail functions."""
