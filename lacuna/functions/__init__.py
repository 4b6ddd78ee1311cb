"""Column functions: text, patterns and spans."""
