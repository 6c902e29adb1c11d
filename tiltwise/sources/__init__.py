"""Reading and writing tables, and simulated data."""
