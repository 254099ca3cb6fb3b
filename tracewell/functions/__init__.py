"""Column functions: text, JSON, regular expressions."""
