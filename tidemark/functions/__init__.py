"""Column builders: statistics and window expressions."""
