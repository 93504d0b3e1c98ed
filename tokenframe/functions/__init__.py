"""Column functions: pre-tokenization, normalization, routing."""
