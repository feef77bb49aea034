"""Column expressions: numbers, texts and hashes."""
