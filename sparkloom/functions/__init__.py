"""Column functions: filters, text of values, updates, key patterns, hashing."""
