"""Readers, listings and versioned tables."""
