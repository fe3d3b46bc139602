"""Readers, writers and resume tables."""
