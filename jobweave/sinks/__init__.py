"""Versioned tables and the load-run log."""
