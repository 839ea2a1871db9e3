"""Column -> Column functions (row-local, built-in Spark expressions)."""
