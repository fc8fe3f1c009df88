"""Spark-native inventory and lineage analytics for batch estates.

Extracts become validated rows, rows become node and edge tables, and the
dependency closure, version history and integrity checks run as DataFrame
plans over those tables.
"""

__version__ = "0.1.0"
