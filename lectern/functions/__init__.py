"""Column functions: one rule each, built from Spark expressions."""
