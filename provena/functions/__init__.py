"""Column functions: text, digests, web addresses, value checks."""
