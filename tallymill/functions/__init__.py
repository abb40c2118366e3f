"""Column expressions: numbers, text, dates and predicates."""
