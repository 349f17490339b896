"""Column expressions: vectors, text, labels, statistics."""
