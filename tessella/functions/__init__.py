"""Column expressions and driver-side arithmetic of the tile model."""
