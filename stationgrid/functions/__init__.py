"""Column-level helpers: cleaning, projection, order statistics."""
