"""Column expressions without state: scalar helpers used by the operators."""
