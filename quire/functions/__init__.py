"""Column functions: text, roles, geometry."""
