"""Column functions: tokens, arrays, PMI and vectors."""
