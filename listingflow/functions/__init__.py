"""Column functions: they take columns and return columns, and never touch rows."""
