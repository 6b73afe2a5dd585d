"""Column functions: text, geometry."""
