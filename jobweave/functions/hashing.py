"""Canonical state text, its digest, and reproducible version ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text_json(value: Column) -> Column:
    """JSON text of one string, escapes included, via a one-element array."""
    wrapped = F.to_json(F.array(value))
    return wrapped.substr(F.lit(2), F.length(wrapped) - 2)


def _value_json(value: Column, kind: T.DataType) -> Column:
    null = F.lit("null")
    if isinstance(kind, T.ArrayType):
        items = F.transform(F.array_sort(F.array_compact(value)), _text_json)
        listed = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
        return F.coalesce(listed, F.lit("[]"))
    if isinstance(kind, T.StringType):
        return F.coalesce(_text_json(value), null)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value.cast("string"), null)
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.coalesce(_text_json(value.cast("string")), null)
    return F.coalesce(value.cast("string"), null)


def state_json(schema: T.StructType, columns: list[str]) -> Column:
    """Deterministic JSON: keys sorted, lists sorted without NULLs, ``", "`` and ``": "``."""
    parts = [
        F.concat(F.lit(f'"{name}": '), _value_json(F.col(name), schema[name].dataType))
        for name in sorted(columns)
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def version_id(entity: Column, state_digest: Column, valid_from: Column) -> Column:
    """Reproducible id of one version row."""
    return F.sha2(F.concat_ws("|", entity, state_digest, valid_from.cast("string")), 256)
