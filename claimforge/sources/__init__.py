"""Sources of the claims library."""
