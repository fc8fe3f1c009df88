"""Derived views over the loaded tables: teams, disagreements, channels, runs, pairs.

These build on the core operators and are optional.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.sources.files import StagedFolder


def bounded_reach(
    edges: DataFrame, source: str, target: str, max_hops: int, starts: DataFrame | None = None
) -> DataFrame:
    """Distinct (source, target) pairs within ``max_hops`` hops, with the fewest hops.

    Breadth first: each pair is visited once, so cycles end by themselves.
    ``starts`` has the sources to walk from; without it every source is one.
    """
    folder = StagedFolder(edges.sparkSession, "reach")
    hop = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).distinct()
    hop, count = folder.write(hop, "edges")
    pairs = hop.select(F.col("_from").alias(source), F.col("_to").alias(target))
    if starts is not None:
        pairs = pairs.join(starts.select(source).distinct(), source, "left_semi")
    schema = pairs.withColumn("hops", F.lit(1)).schema
    frontier, count = folder.write(pairs, "pairs/hops=1")
    hops = 1
    while count and hops < max_hops:
        hops += 1
        further = (
            frontier.join(hop, F.col(target) == F.col("_from"))
            .select(source, F.col("_to").alias(target))
            .distinct()
        )
        seen = folder.read(schema, "pairs").select(source, target)
        frontier, count = folder.write(
            further.join(seen, [source, target], "left_anti"), f"pairs/hops={hops}"
        )
    return folder.read(schema, "pairs")


def support_teams(
    operate_managers: DataFrame, manages: DataFrame, member_of: DataFrame, max_hops: int = 6
) -> DataFrame:
    """Team size per application and group, through the manager's reports.

    ``operate_managers``: (seal_id, manager_id); ``manages``: (manager_id,
    employee_id); ``member_of``: (employee_id, group_name).
    """
    reports = bounded_reach(manages, "manager_id", "employee_id", max_hops, operate_managers)
    # Team size per manager first: applications that share a manager share it.
    sizes = (
        reports.join(member_of, "employee_id")
        .groupBy("manager_id", "group_name")
        .agg(F.countDistinct("employee_id").alias("team_size"))
    )
    return operate_managers.distinct().join(sizes, "manager_id")


def missing_role(entities: DataFrame, memberships: DataFrame, key: str, role: str) -> DataFrame:
    """Entities nobody holds the role for."""
    held = memberships.filter(F.col("role_name") == role).select(key).distinct()
    return entities.select(key).join(held, key, "left_anti")


def holder_not_among(
    left: DataFrame, right: DataFrame, key: str, person: str
) -> DataFrame:
    """Holders on the left who do not appear on the right for the same entity.

    One aggregation over both sides instead of a join of two distinct ones, so
    nothing is sorted. A missing key or person is like no other.
    """
    pair = [key, person]
    # NULL counts for no match, in an aggregation as in a join.
    complete = F.col(key).isNotNull() & F.col(person).isNotNull()
    both = left.select(*pair, F.lit(True).alias("_left"), F.lit(False).alias("_right")).unionByName(
        right.filter(complete).select(*pair, F.lit(False).alias("_left"), F.lit(True).alias("_right"))
    )
    seen = both.groupBy(*pair).agg(F.bool_or("_left").alias("_left"), F.bool_or("_right").alias("_right"))
    return seen.filter("_left AND NOT _right").select(*pair)


def differs_from_all(
    contact: DataFrame, child: DataFrame, key: str, person: str, other: str
) -> DataFrame:
    """Keys whose contact differs from the person of every child that has one.

    Children of a key that name the same person count once, before they are moved.
    """
    pairs = contact.join(child.select(key, other).distinct(), key)
    compared = pairs.groupBy(key, person).agg(
        F.bool_and(F.col(person) != F.col(other)).alias("_all_differ")
    )
    return compared.filter("_all_differ").drop("_all_differ")


def reconciliation_issues(issues: Mapping[str, DataFrame], key: str) -> DataFrame:
    """All issues as (issue, key)."""
    return reduce(
        DataFrame.unionByName,
        [rows.select(F.lit(name).alias("issue"), key) for name, rows in issues.items()],
    )


# Channel kinds a job's work can arrive through.
UPSTREAM_CHANNEL, TIME_CHANNEL = "UpstreamJobChannel", "TimeChannel"


def attribute_channels(
    jobs: DataFrame, requires: DataFrame, emits: DataFrame, keys: Sequence[str],
    inferred: Column, condition: str = "condition",
) -> DataFrame:
    """Where each job's work comes from.

    A required condition another job emits: an upstream job. No required
    condition: time. Otherwise what the job itself suggests (``inferred``).
    """
    emitters = emits.groupBy(condition).agg(
        F.min(F.struct(*keys)).alias("_least"), F.max(F.struct(*keys)).alias("_greatest")
    )
    marked = requires.select(*keys, condition).distinct().join(emitters, condition, "left")
    other = (F.col("_least") != F.struct(*keys)) | (F.col("_greatest") != F.struct(*keys))
    per_job = marked.groupBy(*keys).agg(
        F.max(F.coalesce(other, F.lit(False))).alias("_upstream")
    )
    channel = (
        F.when(F.col("_upstream").isNull(), F.lit(TIME_CHANNEL))
        .when(F.col("_upstream"), F.lit(UPSTREAM_CHANNEL))
        .otherwise(inferred)
    )
    return jobs.join(per_job, list(keys), "left").withColumn("channel", channel).drop("_upstream")


def run_rollup(
    runs: DataFrame, job: Sequence[str], day: str, start_second: str, end_second: str,
    status: str, order: Sequence[str], days: int = 7,
) -> DataFrame:
    """Per job and day: averages over the last ``days`` days, and the day's last run.

    Runs are reduced to one row per job and day first, so the rolling window
    never holds more than a job's days.
    """
    daily = runs.groupBy(*job, day).agg(
        F.count(F.lit(1)).alias("_runs"),
        F.sum(start_second).alias("_start"),
        F.sum(end_second).alias("_end"),
        F.sum(F.col(end_second) - F.col(start_second)).alias("_duration"),
        F.max_by(
            F.struct(
                F.col(start_second).alias("start"), F.col(end_second).alias("end"),
                F.col(status).alias("status"),
            ),
            F.struct(*order),
        ).alias("_last"),
    )
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy(*job).orderBy(number).rangeBetween(-(days - 1), 0)
    total = F.sum("_runs").over(window)
    return daily.select(
        *job,
        day,
        total.alias("runs"),
        (F.sum("_start").over(window) / total).alias("avg_start_second"),
        (F.sum("_end").over(window) / total).alias("avg_end_second"),
        (F.sum("_duration").over(window) / total).alias("avg_duration_second"),
        F.col("_last.start").alias("last_start_second"),
        F.col("_last.end").alias("last_end_second"),
        F.col("_last.status").alias("last_status"),
    )


def pair_checks(
    data: DataFrame, control: DataFrame, keys: Sequence[str],
    checks: Mapping[str, Column],
) -> DataFrame:
    """Data files against control files: which half is missing, each check, certified.

    ``checks`` are boolean expressions over ``data_*`` and ``control_*``
    columns; a pair with a missing half is never certified.
    """
    joined = half(data, keys, "data").join(half(control, keys, "control"), list(keys), "full_outer")
    return checked_pairs(joined, keys, checks)


def half(files: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One side of the pairs: its keys, its other columns under ``name``, and a mark that it is there."""
    rest = [F.col(c).alias(f"{name}_{c}") for c in files.columns if c not in keys]
    return files.select(*keys, *rest, F.lit(True).alias(f"_{name}"))


def checked_pairs(joined: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """Joined halves with the half that is missing, each check, and whether the pair is certified."""
    paired = F.col("_data").isNotNull() & F.col("_control").isNotNull()
    state = (
        F.when(paired, "paired").when(F.col("_data").isNotNull(), "control missing")
        .otherwise("data missing")
    )
    marked = joined.withColumn("pair", state).withColumns(
        {name: F.coalesce(check, F.lit(False)) & paired for name, check in checks.items()}
    )
    passed = reduce(lambda a, b: a & b, [F.col(name) for name in checks])
    return marked.select(*keys, "pair", *checks, passed.alias("certified"))


def reconcile_run_events(
    events: DataFrame, payload: str, datasets: DataFrame, namespace: str
) -> DataFrame:
    """Run events with inputs and outputs, matched to known datasets by namespace and name.

    Gives (run_id, edge, dataset name, matched): USED for inputs,
    WAS_GENERATED_BY for outputs.
    """
    item = "array<struct<namespace: string, name: string>>"
    parsed = events.select(
        F.from_json(
            payload, f"run struct<runId: string>, inputs {item}, outputs {item}"
        ).alias("_e")
    )
    sides = F.array(
        F.struct(F.lit("USED").alias("edge"), F.col("_e.inputs").alias("items")),
        F.struct(F.lit("WAS_GENERATED_BY").alias("edge"), F.col("_e.outputs").alias("items")),
    )
    long = parsed.select(F.col("_e.run.runId").alias("run_id"), F.inline(sides)).select(
        "run_id", "edge", F.inline("items")
    )
    known = datasets.select(
        F.lit(namespace).alias("namespace"), F.col("name"), F.lit(True).alias("_known")
    ).distinct()
    return (
        long.join(known, ["namespace", "name"], "left")
        .withColumn("matched", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def version_changes(history: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each version with the fields that differ from the version before it.

    Versions of one entity are bounded by its snapshot days.
    """
    in_order = Window.partitionBy("entity_key").orderBy("valid_from", "created_at", "snapshot_id")
    before = {f"_was_{f}": F.lag(f).over(in_order) for f in fields}
    numbered = history.withColumns({**before, "_n": F.row_number().over(in_order)})
    changed = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f).eqNullSafe(F.col(f"_was_{f}")), F.lit(f))
                for f in fields
            ]
        )
    )
    return (
        numbered.filter(F.col("_n") > 1)
        .withColumn("changed_fields", changed)
        .drop(*before, "_n")
    )
