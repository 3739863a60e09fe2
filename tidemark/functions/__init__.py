"""Column functions: text, urls and rules."""
