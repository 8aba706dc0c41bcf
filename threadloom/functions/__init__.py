"""Column functions; no UDF among them."""
