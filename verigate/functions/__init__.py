"""Column expressions: text, hashes, rates, structure."""
