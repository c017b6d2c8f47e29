"""Column functions and small aggregations."""
