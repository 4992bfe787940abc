"""Column functions: features and transforms."""
