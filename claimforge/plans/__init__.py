"""Plans of the claims library."""
