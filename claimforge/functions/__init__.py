"""Functions of the claims library."""
