"""Column functions: vectors, text, numbers, geometry."""
