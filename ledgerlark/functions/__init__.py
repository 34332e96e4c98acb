"""Column functions: text, money and time, vectors, hashes."""
