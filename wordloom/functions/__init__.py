"""Column-level functions: text, hash keys, arrays, scaling formulas."""
