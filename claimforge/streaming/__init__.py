"""Streaming of the claims library."""
