"""Column expressions: null handling, ratios, display text and classification."""
