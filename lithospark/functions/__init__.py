"""Column functions for attributes and geometry."""
