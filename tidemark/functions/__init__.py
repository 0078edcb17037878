"""Column functions: atoms, text, geometry and scores."""
