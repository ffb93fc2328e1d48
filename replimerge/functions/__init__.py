"""Column functions: version vectors, entries and paths."""
