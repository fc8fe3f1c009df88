"""Micro-batch application of the batch merges."""
