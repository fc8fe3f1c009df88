"""Wide rows to long rows, and delimited lists to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.coerce import split_list


def wide_to_long(
    df: DataFrame,
    kept: Sequence[str],
    pairs: Mapping[str, Sequence[str | None]],
    columns: Sequence[str],
    label: str,
    position: str = "_position",
) -> DataFrame:
    """One row per named group of columns whose first column is set.

    ``pairs`` maps a label to the source columns feeding ``columns`` in order
    (None: NULL). The group's position is kept, so a later merge can order
    rows that came from the same wide row. No shuffle.
    """

    def cell(source: str | None) -> Column:
        return F.lit(None) if source is None else F.col(source)

    groups = F.array(
        *[
            F.struct(
                F.lit(i).alias(position),
                F.lit(name).alias(label),
                *[cell(source).alias(out) for source, out in zip(sources, columns)],
            )
            for i, (name, sources) in enumerate(pairs.items())
        ]
    )
    return df.select(*kept, F.inline(groups)).filter(F.col(columns[0]).isNotNull())


def splay_list(
    df: DataFrame, column: str, into: str, separator: str = ","
) -> DataFrame:
    """One row per distinct item of a delimited text column."""
    items = F.array_distinct(split_list(column, separator))
    return df.select(*[c for c in df.columns if c != column], F.explode(items).alias(into))


def flag_orphans(items: DataFrame, known: DataFrame, key: str, flag: str = "orphan") -> DataFrame:
    """Mark rows whose reference is not in ``known``; nothing is dropped."""
    seen = known.select(key).distinct().withColumn("_known", F.lit(True))
    return items.join(seen, key, "left").withColumn(flag, F.col("_known").isNull()).drop("_known")
