"""Tolerant text-to-type coercion as Column expressions.

Every parser returns NULL for text it cannot read, so a bad cell is routed to
the reject output and never aborts an ANSI-mode job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space a cell is stripped of, the texts one domain reads
# as NULL, and the accepted yes / no tokens.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NULL_TOKENS = ("", "[null]", "null", "none", "n/a", "na")
YES_TOKENS = ("yes", "y", "true", "t", "1")
NO_TOKENS = ("no", "n", "false", "f", "0")

_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space (not only blanks) from both ends."""
    return F.btrim(col(c).cast("string"), F.lit(WHITE_SPACE))


def blank_to_null(c: Column | str) -> Column:
    """Stripped text; empty becomes NULL."""
    return F.nullif(strip(c), F.lit(""))


def tokens_to_null(c: Column | str) -> Column:
    """Stripped text; any of the NULL tokens, in any case, becomes NULL."""
    text = strip(c)
    return F.when(~F.lower(text).isin(*NULL_TOKENS), text)


def to_integer(c: Column | str) -> Column:
    text = strip(c)
    return F.when(text.rlike(_INTEGER), text.try_cast("bigint"))


def to_number(c: Column | str) -> Column:
    text = strip(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_flag(c: Column | str) -> Column:
    """Yes / no tokens to boolean; anything else is NULL, never an error."""
    text = F.lower(tokens_to_null(c))
    return F.when(text.isin(*YES_TOKENS), F.lit(True)).when(text.isin(*NO_TOKENS), F.lit(False))


def to_strict_flag(c: Column | str) -> Column:
    """As :func:`to_flag` plus on / off; the caller rejects what stays NULL."""
    text = F.lower(strip(c))
    return F.when(text.isin(*YES_TOKENS, "on"), F.lit(True)).when(
        text.isin(*NO_TOKENS, "off"), F.lit(False)
    )


def to_day(c: Column | str) -> Column:
    """ISO calendar date from the first ten characters."""
    text = F.substring(strip(c), 1, 10)
    return F.when(
        text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd")
    ).when(text.rlike(r"^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))


def to_short_day(c: Column | str) -> Column:
    """Dates written like ``24-Aug-12``; they are stored as text and parsed on demand."""
    return F.try_to_date(strip(c), "d-MMM-yy")


def split_list(c: Column | str, separator: str) -> Column:
    """Delimited text to a list of non-empty, stripped parts."""
    parts = F.transform(F.split(col(c), f"\\Q{separator}\\E"), lambda part: strip(part))
    return F.filter(parts, lambda part: part != "")
