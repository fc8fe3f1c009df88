"""Canonical role names from the spellings seen in contact extracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.coerce import tokens_to_null
from jobweave.functions.names import code_lookup

# Each canonical role with the spellings read as that role.
ROLE_SPELLINGS = {
    "Application Owner": ("app owner", "application owner", "ao"),
    "Primary Information Owner": (
        "primary information owner",
        "pio",
        "data owner",
        "info owner",
        "information owner",
    ),
    "Backup Information Owner": ("backup information owner", "bio"),
    "CTO": ("cto", "chief technology officer", "chief tech officer"),
    "Design Authority": ("design authority", "da"),
    "Chief Business Technologist": ("chief business technologist", "cbt"),
    "L1 Operate Manager": ("l1 operate manager", "l1 ops manager"),
    "L2 Operate Manager": ("l2 operate manager", "l2 ops manager", "l2 manager", "operate manager"),
    "Backup Application Owner": ("backup application owner", "bao"),
    "Risk Manager": ("risk manager", "rm"),
}
ROLE_BY_SPELLING = {s: role for role, spellings in ROLE_SPELLINGS.items() for s in spellings}

# Declared state and risk domains (checked on demand, never a reject).
APPLICATION_STATES = ("Build", "Operate", "Retire", "Unknown")
RISK_LEVELS = ("Low", "Medium", "High", "Critical")


def canonical_role(c: Column | str) -> Column:
    """Canonical role, or NULL for an unknown spelling."""
    return code_lookup(F.lower(tokens_to_null(c)), ROLE_BY_SPELLING)
