"""Column resolution, cleaning and feature expressions."""
