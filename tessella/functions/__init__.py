"""Column expressions: normalizers, predicates and comparisons."""
