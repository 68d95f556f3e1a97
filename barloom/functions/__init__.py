"""Column functions used across the library."""
