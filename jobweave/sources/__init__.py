"""Readers, static vocabularies and row specs."""
