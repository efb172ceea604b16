"""Column expressions and parsers for records of scientific literature."""
