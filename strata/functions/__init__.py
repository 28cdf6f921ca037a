"""Column expressions: keys, validation, encoded sizes."""
