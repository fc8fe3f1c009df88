"""Idempotent merges of a batch into a node or edge table.

The batch is first collapsed to one row per key with partial aggregation, so a
key holding a third of all rows is reduced on the map side. Both sides of the
join that follows have unique keys, so no key can be hot there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.sources.readers import SEQ


@dataclass(frozen=True)
class Merge:
    """How the columns of a batch meet the rows already there.

    ``create_only``: the first batch row's value, kept once the row exists.
    ``set_columns``: the last batch row's value, NULL included.
    ``keep_old``: the last non-NULL batch value, else what was there.
    """

    keys: tuple[str, ...]
    create_only: tuple[str, ...] = ()
    set_columns: tuple[str, ...] = ()
    keep_old: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, *self.create_only, *self.set_columns, *self.keep_old)


def collapse(batch: DataFrame, merge: Merge, seq: str = SEQ) -> DataFrame:
    """One row per key: first-wins, last-wins and last-non-NULL columns."""
    order = F.col(seq)
    wanted: list[Column] = []
    if merge.create_only:
        wanted.append(F.min_by(_row(merge.create_only), order).alias("_first"))
    if merge.set_columns:
        wanted.append(F.max_by(_row(merge.set_columns), order).alias("_last"))
    for name in merge.keep_old:
        wanted.append(F.max_by(F.col(name), F.when(F.col(name).isNotNull(), order)).alias(name))
    if not wanted:
        return batch.select(*merge.keys).distinct()
    grouped = batch.groupBy(*merge.keys).agg(*wanted)
    return grouped.select(
        *merge.keys,
        *_unpacked("_first", merge.create_only),
        *_unpacked("_last", merge.set_columns),
        *merge.keep_old,
    )


def _row(columns: Sequence[str]) -> Column:
    """Several columns travel as one row; a single one stays plain, which can hash-aggregate."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def _unpacked(packed: str, columns: Sequence[str]) -> list[Column]:
    if len(columns) == 1:
        return [F.col(packed).alias(columns[0])]
    return [F.col(f"{packed}.{c}").alias(c) for c in columns]


def upsert(
    target: DataFrame | None,
    batch: DataFrame,
    merge: Merge,
    seq: str = SEQ,
    collapsed: bool = False,
    small: bool = False,
) -> DataFrame:
    """The table after the batch, column by column.

    Target columns the batch does not carry stay as they are, and are NULL on
    new rows, so a stub holding only its key is the same call.

    The batch meets the table in one full outer join. A caller that has staged a
    ``small`` batch, such as a micro-batch, says so: existing rows then pick up
    their changes in a left join, which can broadcast the batch, and only rows
    with new keys are added. Both ways give the same rows.
    """
    new = batch.select(*merge.columns) if collapsed else collapse(batch, merge, seq)
    if target is None:
        return new
    extra = [c for c in new.columns if c not in target.columns]
    old_side = target.select(
        *merge.keys,
        *[F.col(c).alias(f"_old_{c}") for c in target.columns if c not in merge.keys],
        F.lit(1).alias("_old"),
    )
    new_side = new.select(
        *merge.keys,
        *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in merge.keys],
        F.lit(1).alias("_new"),
    )
    keys = list(merge.keys)
    ordered = [c for c in target.columns if c not in merge.keys] + extra
    if small:
        updated = old_side.join(new_side, keys, "left")
        present = target.select(*keys).join(new.select(*keys), keys, "left_semi")
        added = new.join(present, keys, "left_anti")
        rest = {
            f.name: F.lit(None).cast(f.dataType).alias(f.name)
            for f in target.schema
            if f.name not in new.columns
        }
        return updated.select(*keys, *_merged(ordered, merge, target.columns)).unionByName(
            added.select(*keys, *[rest.get(c, F.col(c)) for c in ordered])
        )
    joined = old_side.join(new_side, keys, "full_outer")
    return joined.select(*keys, *_merged(ordered, merge, target.columns))


def _merged(names: Sequence[str], merge: Merge, known: Sequence[str]) -> list[Column]:
    """Each column of a joined old and new row; presence is a marker, never a data column."""
    in_old, in_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(name: str) -> Column:
        old = F.col(f"_old_{name}") if name in known else F.lit(None)
        if name in merge.create_only:
            return F.when(in_old, old).otherwise(F.col(f"_new_{name}"))
        if name in merge.set_columns:
            return F.when(in_new, F.col(f"_new_{name}")).otherwise(old)
        if name in merge.keep_old:
            return F.coalesce(F.col(f"_new_{name}"), old)
        return old

    return [value(name).alias(name) for name in names]


_AT = "_at_"


def order_columns(merge: Merge) -> tuple[str, ...]:
    """The columns that hold where each group of values stands in the input's order."""
    return (
        *([f"{_AT}first"] if merge.create_only else ()),
        *([f"{_AT}last"] if merge.set_columns else ()),
        *[f"{_AT}{c}" for c in merge.keep_old],
    )


def without_order(df: DataFrame, merge: Merge) -> DataFrame:
    """An ordered table as its readers want it."""
    return df.drop(*order_columns(merge))


def collapse_ordered(batch: DataFrame, merge: Merge, seq: str = SEQ) -> DataFrame:
    """:func:`collapse`, and beside each group of values its place in the order."""
    order = F.col(seq)
    places = []
    if merge.create_only:
        places.append(F.min(order).alias(f"{_AT}first"))
    if merge.set_columns:
        places.append(F.max(order).alias(f"{_AT}last"))
    for name in merge.keep_old:
        places.append(F.max(F.when(F.col(name).isNotNull(), order)).alias(f"{_AT}{name}"))
    wanted: list[Column] = []
    if merge.create_only:
        wanted.append(F.min_by(_row(merge.create_only), order).alias("_first"))
    if merge.set_columns:
        wanted.append(F.max_by(_row(merge.set_columns), order).alias("_last"))
    for name in merge.keep_old:
        wanted.append(F.max_by(F.col(name), F.when(F.col(name).isNotNull(), order)).alias(name))
    if not wanted:
        return batch.select(*merge.keys).distinct()
    return batch.groupBy(*merge.keys).agg(*wanted, *places).select(
        *merge.keys,
        *_unpacked("_first", merge.create_only),
        *_unpacked("_last", merge.set_columns),
        *merge.keep_old,
        *order_columns(merge),
    )


def upsert_ordered(
    target: DataFrame | None, batch: DataFrame, merge: Merge, seq: str = SEQ, collapsed: bool = False, small: bool = False
) -> DataFrame:
    """The table after the batch, whatever order batches come in.

    The table keeps the places of its values (:func:`order_columns`), and a
    batch's values win only if theirs are earlier (``create_only``) or as late
    (the others). So batches may arrive late, in any order and more than once,
    and the table is what one batch of all rows gives, if rows of a key do not
    share a place. Rows without a place never win. ``small`` is that of
    :func:`upsert`; columns that only the table has stay as they are.
    """
    places = order_columns(merge)
    new = batch.select(*merge.columns, *places) if collapsed else collapse_ordered(batch, merge, seq)
    if target is None:
        return new
    groups = [("first", merge.create_only), ("last", merge.set_columns), *[(c, (c,)) for c in merge.keep_old]]
    packed = [(f"{_AT}{at}", names) for at, names in groups if names]
    keys = list(merge.keys)
    rest = [c for c in target.columns if c not in new.columns]

    def side(df: DataFrame, mark: str, more: Sequence[str] = ()) -> DataFrame:
        states = [F.struct(F.col(at).alias("at"), *names).alias(f"{mark}{at}") for at, names in packed]
        return df.select(*keys, *states, *more, F.lit(1).alias(mark))

    old_side, new_side = side(target, "_old", rest), side(new, "_new")
    joined = old_side.join(new_side, keys, "left" if small else "full_outer")

    def winner(at: str) -> Column:
        old, new_state = F.col(f"_old{at}"), F.col(f"_new{at}")
        earlier = at == f"{_AT}first" and bool(merge.create_only)
        wins = new_state["at"] < old["at"] if earlier else new_state["at"] >= old["at"]
        wins = F.col("_old").isNull() | (new_state["at"].isNotNull() & (old["at"].isNull() | wins))
        return F.when(wins, new_state).otherwise(old)

    chosen = joined.select(*keys, *[winner(at).alias(at) for at, _ in packed], *rest)
    values = [F.col(f"{at}.{c}").alias(c) for at, names in packed for c in names]
    merged = chosen.select(*keys, *values, *rest, *[F.col(f"{at}.at").alias(at) for at, _ in packed])
    if small:
        present = target.select(*keys).join(new.select(*keys), keys, "left_semi")
        merged = merged.unionByName(new.join(present, keys, "left_anti"), allowMissingColumns=True)
    return merged.select(*target.columns)


def require_parents(
    child: DataFrame, parent: DataFrame, on: Mapping[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists, and the rows a merge would have dropped.

    ``on`` maps child columns to parent columns. Parent keys are made distinct
    first: that reduces a hot key before the shuffle the join needs anyway.
    """
    renamed = parent.select(*[F.col(p).alias(f"_parent_{c}") for c, p in on.items()]).distinct()
    matches = [F.col(c) == F.col(f"_parent_{c}") for c in on]
    return child.join(renamed, matches, "left_semi"), child.join(renamed, matches, "left_anti")


def dimension(df: DataFrame, column: str, key: str) -> DataFrame:
    """Distinct non-NULL values of one column as a table of keys."""
    return df.select(F.col(column).alias(key)).filter(F.col(key).isNotNull()).distinct()


def fixed_children(df: DataFrame, kinds: Sequence[str], kind: str = "kind") -> DataFrame:
    """One child row per parent row and fixed kind, without a join."""
    listed = F.array(*[F.lit(k) for k in kinds])
    return df.select("*", F.explode(listed).alias(kind))


def is_given(column: str) -> Column:
    """The optional reference is present and not blank."""
    return F.col(column).isNotNull() & (F.trim(F.col(column)) != "")


def optional_reference(df: DataFrame, column: str) -> DataFrame:
    """Rows that carry a usable reference."""
    return df.filter(is_given(column))


def union_in_order(first: DataFrame, *others: DataFrame, seq: str = SEQ) -> DataFrame:
    """Several batches as one, all rows of an earlier batch before a later one."""
    parts = [
        frame.withColumn(seq, F.struct(F.lit(i).alias("batch"), F.col(seq).alias("row")))
        for i, frame in enumerate((first, *others))
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def provenance(df: DataFrame, keys: Sequence[str], run_id: str, source: str, at: Column) -> DataFrame:
    """Entity-to-run edges for one load."""
    return df.select(*keys).distinct().select(
        *keys,
        F.lit(run_id).alias("run_id"),
        F.lit(source).alias("source"),
        at.alias("first_seen_at"),
        at.alias("last_seen_at"),
    )


def rename_keys(df: DataFrame, column: str, renames: Mapping[str, str]) -> DataFrame:
    """Rewrite one key column through a small rename map (for edges of a renamed row)."""
    value = F.col(column)
    mapped = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])[value]
    return df.withColumn(column, F.coalesce(mapped, value))
