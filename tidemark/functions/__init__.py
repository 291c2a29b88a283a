"""Column functions: no DataFrame, no action, only Spark expressions."""
