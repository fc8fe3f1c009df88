"""Folder-name decomposition as plain column expressions.

``<prefix>-<segment>-...``: a prefix of six or more characters carries the
environment (1), line of business (2), application code (3-5) and folder type
(6); everything after the first dash is kept as a list of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.coerce import col, strip

# Code letters and the names they stand for.
ENVIRONMENTS = {"P": "Production", "D": "Development", "Q": "QA"}
LINES_OF_BUSINESS = {"R": "Retail", "Y": "Testing3", "K": "Testing2", "B": "Testing"}
FOLDER_TYPES = {
    "G": "Group Table/Smart folder",
    "D": "Daily",
    "W": "Weekly",
    "M": "Monthly",
    "Q": "Quarterly",
    "H": "Holiday",
    "R": "Request Job/ Ad-hoc",
}


def code_lookup(code: Column, names: dict[str, str]) -> Column:
    """Name for a code from a small literal map; NULL when the code is unknown."""
    literal = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return literal[code]


def folder_name_columns(name: Column | str) -> dict[str, Column]:
    """The ten decomposed columns of one folder-name column."""
    raw = F.coalesce(strip(name), F.lit(""))
    prefix = F.substring_index(raw, "-", 1)
    long_enough = F.length(prefix) >= 6

    def letters(start: int, count: int) -> Column:
        return F.when(long_enough, F.upper(F.substring(prefix, start, count)))

    environment = code_lookup(letters(1, 1), ENVIRONMENTS)
    lob = code_lookup(letters(2, 1), LINES_OF_BUSINESS)
    app_code = letters(3, 3)
    type_code = letters(6, 1)
    segments = F.when(
        F.instr(raw, "-") > 0, F.slice(F.split(raw, "-"), F.lit(2), F.size(F.split(raw, "-")) - 1)
    ).otherwise(F.array().cast("array<string>"))
    return {
        "prefix": prefix,
        "environment_code": F.when(environment.isNotNull(), letters(1, 1)),
        "environment": environment,
        "lob_code": F.when(lob.isNotNull(), letters(2, 1)),
        "lob": lob,
        "app_code": F.when(app_code.rlike(r"^\p{L}{3}$"), app_code),
        "folder_type_code": type_code,
        "folder_type": code_lookup(type_code, FOLDER_TYPES),
        "segments": segments,
        "prefix_recognized": environment.isNotNull(),
    }


def with_folder_name(df: DataFrame, name: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Add the decomposed columns (or the chosen ones) next to ``name``."""
    parsed = folder_name_columns(col(name))
    return df.withColumns({k: v for k, v in parsed.items() if only is None or k in only})
