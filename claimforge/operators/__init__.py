"""Operators of the claims library."""
