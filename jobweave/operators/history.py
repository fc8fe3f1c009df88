"""Version history: entity states, hash-compared versions, pruning, dated lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.hashing import digest, state_json, version_id
from jobweave.session import RunClock

VERSION_COLUMNS = (
    "snapshot_id", "entity_key", "hash", "state_json", "valid_from", "valid_to", "created_at",
)


def _version_order() -> Column:
    """Versions order by start date; creation time, being open and id break ties."""
    return F.struct("valid_from", "created_at", F.col("valid_to").isNull().alias("open"), "snapshot_id")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row per key by partial aggregation; no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def sorted_members(df: DataFrame, entity: str, member: str, into: str) -> DataFrame:
    """Sorted distinct members per entity, NULLs dropped.

    Duplicates go first, in a shuffle by both columns, so a popular entity
    only brings its distinct members together.
    """
    pairs = df.select(entity, member).filter(F.col(member).isNotNull()).distinct()
    return pairs.groupBy(entity).agg(F.array_sort(F.collect_list(member)).alias(into))


def _with_members(
    state: DataFrame, key: str, edges: DataFrame | None, edge_key: str, member: str, into: str
) -> DataFrame:
    empty = F.array().cast("array<string>")
    if edges is None:
        return state.withColumn(into, empty)
    listed = sorted_members(edges, edge_key, member, into).withColumnRenamed(edge_key, key)
    return state.join(listed, key, "left").withColumn(into, F.coalesce(into, empty))


def _least_parent(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """One parent per child; an arbitrary choice among several is made the least."""
    return edges.groupBy(child).agg(F.min(parent).alias(parent))


def application_state(
    application: DataFrame,
    has_membership: DataFrame,
    held_by: DataFrame,
    product_application: DataFrame | None = None,
    application_team: DataFrame | None = None,
) -> DataFrame:
    """State of every application: own columns, product, teams and contacts."""
    own = ["status", "risk_level", "sox_governed", "deployment_module"]
    types = {"sox_governed": "boolean"}
    state = application.select(
        "seal_id",
        *[
            F.col(c) if c in application.columns else F.lit(None).cast(types.get(c, "string")).alias(c)
            for c in own
        ],
    )
    if product_application is None:
        state = state.withColumn("product_id", F.lit(None).cast("string"))
    else:
        state = state.join(
            _least_parent(product_application, "seal_id", "product_id"), "seal_id", "left"
        )
    state = _with_members(state, "seal_id", application_team, "seal_id", "team_id", "dev_team_ids")
    contacts = has_membership.select("seal_id", "membership_id").join(
        held_by.select("membership_id", "employee_id"), "membership_id"
    )
    return _with_members(state, "seal_id", contacts, "seal_id", "employee_id", "contact_ids")


def product_state(
    product: DataFrame, has_product: DataFrame, product_application: DataFrame | None = None
) -> DataFrame:
    state = product.select("product_id", "name").join(
        _least_parent(has_product, "product_id", "product_line_id"), "product_id", "left"
    )
    return _with_members(
        state, "product_id", product_application, "product_id", "seal_id", "seal_ids"
    )


def lob_state(lob: DataFrame, has_product_line: DataFrame, reconciles_to: DataFrame) -> DataFrame:
    state = lob.select("lob_id", "code", "name")
    state = _with_members(
        state, "lob_id", has_product_line, "lob_id", "product_line_id", "product_line_ids"
    )
    return _with_members(state, "lob_id", reconciles_to, "lob_id", "segment_code", "segment_codes")


def hashed_state(state: DataFrame, key: str) -> DataFrame:
    """``(entity_key, state_json, hash)`` of a state frame."""
    columns = [c for c in state.columns if c != key]
    return (
        state.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("entity_key"), state_json(state.schema, columns).alias("state_json"))
        .withColumn("hash", digest(F.col("state_json")))
    )


def compare_states(state: DataFrame, history: DataFrame | None) -> DataFrame:
    """Each entity's state with ``changed``: no version yet, or another latest hash."""
    if history is None:
        return state.withColumn("changed", F.lit(True))
    latest = history.groupBy("entity_key").agg(
        F.max_by("hash", _version_order()).alias("_latest_hash")
    )
    return (
        state.join(latest, "entity_key", "left")
        .withColumn("changed", ~F.col("_latest_hash").eqNullSafe(F.col("hash")))
        .drop("_latest_hash")
    )


def new_versions(compared: DataFrame, clock: RunClock) -> DataFrame:
    """The version that opens at this run for each changed entity."""
    return compared.filter("changed").select(
        version_id(F.col("entity_key"), F.col("hash"), clock.timestamp()).alias("snapshot_id"),
        "entity_key",
        "hash",
        "state_json",
        clock.day().alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        clock.timestamp().alias("created_at"),
    )


def close_versions(opened: DataFrame, changed: DataFrame, clock: RunClock) -> DataFrame:
    """Open versions, those of changed entities with the run's day as their end."""
    keys = changed.select("entity_key", F.lit(True).alias("_changed"))
    met = opened.join(keys, "entity_key", "left")
    return met.withColumn("valid_to", F.when(F.col("_changed"), clock.day())).select(*opened.columns)


def advance_versions(compared: DataFrame, history: DataFrame | None, clock: RunClock) -> DataFrame:
    """History after a run: changed entities close their open versions and get a new one.

    ``[valid_from, valid_to)`` intervals; entities that are gone keep their
    open version. Closed versions pass through without a join.
    """
    new = new_versions(compared, clock)
    if history is None:
        return new
    history = history.select(*VERSION_COLUMNS)
    opened = history.filter(F.col("valid_to").isNull())
    met = close_versions(opened, compared.filter("changed"), clock)
    return history.filter(F.col("valid_to").isNotNull()).unionByName(met).unionByName(new)


def snapshot_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count_if("changed").alias("new"), F.count_if(~F.col("changed")).alias("unchanged")
    )


def versions_of_dated_states(
    states: DataFrame, entity: str, day: str, state_hash: str
) -> DataFrame:
    """Bulk form of the version step over many dated states per entity.

    ``states`` holds one state per (entity, day), so a group is bounded by the
    number of snapshot days however many source rows an entity has.
    """
    in_order = Window.partitionBy(entity).orderBy(day)
    previous = F.lag(state_hash).over(in_order)
    starts = states.withColumn("_starts", ~F.col(state_hash).eqNullSafe(previous)).filter("_starts")
    return starts.drop("_starts").withColumns(
        {"valid_from": F.col(day), "valid_to": F.lead(day).over(in_order)}
    )


def retention_cutoff(run_date: date, years: int = 5) -> date:
    return run_date - timedelta(days=365 * years)


def prune_versions(history: DataFrame, run_date: date, years: int = 5) -> DataFrame:
    """Drop versions that began before the cutoff, except an entity's newest.

    Versions inside the window are kept by a filter alone. Only the newest
    version of each entity is looked for among all of them, by aggregation.
    """
    cutoff = F.lit(retention_cutoff(run_date, years))
    newest = latest_per_key(history, ["entity_key"], _version_order())
    return history.filter(F.col("valid_from") >= cutoff).unionByName(
        newest.filter(F.col("valid_from") < cutoff)
    )


def pruned_count(history: DataFrame, run_date: date, years: int = 5) -> DataFrame:
    """How many versions :func:`prune_versions` deletes, in one aggregation."""
    cutoff = F.lit(retention_cutoff(run_date, years))
    per_entity = history.groupBy("entity_key").agg(
        F.count_if(F.col("valid_from") < cutoff).alias("_old"),
        F.max("valid_from").alias("_newest"),
    )
    kept = (F.col("_newest") < cutoff).cast("int")
    return per_entity.agg(F.coalesce(F.sum(F.col("_old") - kept), F.lit(0)).alias("deleted"))


def in_force(day: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Both boundary dates belong to the range; an open end never expires."""
    return (day >= F.col(start)) & (F.col(end).isNull() | (day <= F.col(end)))


#: Days are numbered from the first day of year 1; 2 ** 22 of them reach beyond year 9999.
_LEVELS = 22


def _day_number(day: str) -> str:
    return f"(unix_date({day}) + 719163)"


def dyadic_nodes(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Each range once per interval it is made of, as ``_level`` and ``_node``.

    An interval of level k is a stretch of 2 ** k days that starts at a multiple
    of that; a range is made of at most two of each level, and an open end lasts
    to the last day. A day lies in a range exactly if one of the intervals that
    hold the day, one per level, is among them. A range without a start, or one
    that ends before it starts, is made of none.
    """
    first = f"shiftright({_day_number(f'CAST(`{start}` AS DATE)')} + shiftleft(1L, k) - 1, k)"
    last = f"(shiftright(coalesce({_day_number(f'CAST(`{end}` AS DATE)')}, {(1 << _LEVELS) - 1}) + 1L, k) - 1)"
    found = f"""filter(flatten(transform(sequence(0, {_LEVELS}), k -> array(
        IF({first} <= {last} AND {first} % 2 = 1, struct(k AS _level, {first} AS _node), NULL),
        IF({first} <= {last} AND {last} % 2 = 0, struct(k AS _level, {last} AS _node), NULL)))), n -> n IS NOT NULL)"""
    return ranges.select("*", F.expr(f"inline({found})"))


def effective_join(
    facts: DataFrame,
    ranges: DataFrame,
    day: str,
    on: Sequence[str] = (),
    start: str = "effective_from",
    end: str = "effective_to",
) -> DataFrame:
    """Facts with the dated rows in force on their day.

    With key columns it is an equi join and a residual range test. Without
    keys, each different day meets the ranges by the intervals that hold it
    (:func:`dyadic_nodes`), and the facts of a day then meet what it met. No
    bucket of the first join holds more days than one, nor other ranges than
    those in force all through its interval, whatever the ranges' lengths; the
    second has at most as many rows as the result.
    """
    if on:
        return facts.join(ranges, list(on)).filter(in_force(F.col(day), start, end))
    days = facts.select(F.col(day).cast("date").alias("_day")).filter("_day IS NOT NULL").distinct()
    held = days.select(
        "_day",
        F.expr(
            f"inline(transform(sequence(0, {_LEVELS}), k -> "
            f"struct(k AS _level, shiftright(CAST({_day_number('_day')} AS BIGINT), k) AS _node)))"
        ),
    )
    met = held.join(dyadic_nodes(ranges, start, end), ["_level", "_node"]).drop("_level", "_node")
    return facts.join(met, F.col(day).cast("date") == F.col("_day")).drop("_day")


def active_segments(current_edges: DataFrame) -> DataFrame:
    """Number and sorted list of the segments with a current edge."""
    return current_edges.agg(
        F.count(F.lit(1)).alias("active_segments"),
        F.array_sort(F.collect_list("segment_code")).alias("codes"),
    )
