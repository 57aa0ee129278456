"""Column functions: distances and product quantisation."""
