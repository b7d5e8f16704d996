"""Column functions: text, vectors, phrases."""
