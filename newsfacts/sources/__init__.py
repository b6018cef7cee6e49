"""Readers, writers and the adapter over the star-schema tables."""
