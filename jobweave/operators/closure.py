"""Bounded predecessor closure over emitted and required conditions.

A job depends on every job that emits a condition it requires. The closure
walks these dependencies backwards, level by level, up to ``max_level``. Each
level is one join whose result is written to the shared folder: lineage stays
one level deep, a lost executor repeats one level only, and the next level is
planned from the real size of this one. The join on a popular condition or job
name is split by adaptive skew handling, since nothing but a write follows it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.operators.extras import bounded_reach
from jobweave.sources.files import StagedFolder

ARROW = " -> "
LINK_COLUMNS = (
    "condition", "folder", "folder_id", "job", "job_id", "cyclic_type", "version_serial",
)
# The thirteen columns of a dependency row, in order.
DEPENDENCY_COLUMNS = (
    "in_parent_table", "in_job_name", "in_parent_table_id", "in_job_id", "in_table_job_id",
    "out_condition", "dependent_table", "dependent_job", "dependent_table_id",
    "dependent_job_id", "out_table_job_id", "recursion_level", "dependency_path",
)
EDGE_KEYS = (
    "in_parent_table_id", "in_job_id", "dependent_table_id", "dependent_job_id", "out_condition",
)
_SUCCESSOR = ("in_parent_table", "in_job_name", "in_parent_table_id", "in_job_id")
_PREDECESSOR = ("dependent_table", "dependent_job", "dependent_table_id", "dependent_job_id")
# What an edge walk starts from; further hops go by job name alone.
_START = ("in_parent_table_id", "in_job_id", "in_job_name")


def active_folders(folders: DataFrame) -> DataFrame:
    """Folders with a scheduling flag; an empty flag counts as none."""
    return folders.filter(F.coalesce(F.trim("user_daily"), F.lit("")) != "")


def job_links(
    jobs: DataFrame, folders: DataFrame, links: DataFrame, only_posting: bool = False
) -> DataFrame:
    """Distinct (condition, job) pairs of jobs in active folders.

    A link belongs to a job when folder, job and version agree. All versions
    count; ``only_posting`` keeps links that add a condition (sign ``+``).
    """
    if only_posting:
        links = links.filter(F.col("sign") == "+")
    kept = jobs.join(active_folders(folders).select("folder_id"), "folder_id", "left_semi")
    link = links.select("folder_id", "job_id", "version_serial", "condition_name")
    return (
        kept.join(link, ["folder_id", "job_id", "version_serial"])
        .select(
            F.col("condition_name").alias("condition"),
            F.col("parent_table").alias("folder"),
            "folder_id",
            F.col("job_name").alias("job"),
            "job_id",
            "cyclic_type",
            "version_serial",
        )
        .distinct()
    )


def anchored(
    consumes: DataFrame, folders: Sequence[str] | None = None, like: str | None = None
) -> DataFrame:
    """Consumers of the chosen folders: by exact name, by pattern, or all."""
    if folders is not None:
        consumes = consumes.filter(F.col("folder").isin(list(folders)))
    if like is not None:
        consumes = consumes.filter(F.col("folder").like(like))
    return consumes


def _producers(produces: DataFrame) -> DataFrame:
    return produces.select(
        F.col("condition").alias("_produced"),
        F.col("folder").alias("dependent_table"),
        F.col("job").alias("dependent_job"),
        F.col("folder_id").alias("dependent_table_id"),
        F.col("job_id").alias("dependent_job_id"),
        F.col("cyclic_type").alias("_cyclic_out"),
    )


def _pairs(consumes: DataFrame, produces: DataFrame, match_cyclic: bool) -> DataFrame:
    """Consumer and producer rows that share a condition and differ in job name."""
    matched = (F.col("condition") == F.col("_produced")) & (F.col("job") != F.col("dependent_job"))
    if match_cyclic:
        matched = matched & (F.col("cyclic_type") == F.col("_cyclic_out"))
    return consumes.join(_producers(produces), matched)


def direct_dependencies(
    consumes: DataFrame, produces: DataFrame, match_cyclic: bool = False
) -> DataFrame:
    """Level one: each consumer with each producer of a condition it requires.

    ``_names`` lists the predecessors walked so far, nearest first.
    """
    return _pairs(consumes, produces, match_cyclic).select(
        F.col("folder").alias("in_parent_table"),
        F.col("job").alias("in_job_name"),
        F.col("folder_id").alias("in_parent_table_id"),
        F.col("job_id").alias("in_job_id"),
        F.col("condition").alias("out_condition"),
        *_PREDECESSOR,
        F.array("dependent_job").alias("_names"),
    )


def _path() -> Column:
    return F.concat_ws(ARROW, "in_job_name", "_names")


def _unseen(guard: str) -> Column:
    """Cycle guard between a path (``_path``, ``_so_far``) and the ``_more`` names after it.

    ``substring`` also stops at a job whose name is part of one on the path;
    ``exact`` compares whole names.
    """
    if guard == "substring":
        return F.forall("_more", lambda name: F.instr(F.col("_path"), name) == 0)
    if guard == "exact":
        return ~F.arrays_overlap("_so_far", "_more")
    raise ValueError(f"unknown guard {guard!r}")


def _with_level(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("recursion_level", T.IntegerType())])


def _extended(front: DataFrame, steps: DataFrame, guard: str) -> DataFrame:
    """Paths of ``front`` continued by every path of ``steps`` that starts where they end."""
    left = front.select(
        *_SUCCESSOR,
        F.col("dependent_job").alias("_at"),
        F.col("_names").alias("_walked"),
        F.concat(F.array("in_job_name"), "_names").alias("_so_far"),
        _path().alias("_path"),
        F.col("recursion_level").alias("_level"),
    )
    right = steps.select(
        F.col("in_job_name").alias("_from"),
        "out_condition",
        *_PREDECESSOR,
        F.col("_names").alias("_more"),
        "recursion_level",
    )
    joined = left.join(right, F.col("_at") == F.col("_from")).filter(_unseen(guard))
    return joined.select(
        *_SUCCESSOR,
        "out_condition",
        *_PREDECESSOR,
        F.concat("_walked", "_more").alias("_names"),
        (F.col("_level") + F.col("recursion_level")).alias("recursion_level"),
    )


def _walk_stepwise(
    anchor: DataFrame,
    steps_from: Callable[[DataFrame], DataFrame],
    folder: StagedFolder,
    max_level: int,
    guard: str,
) -> DataFrame:
    """Guarded paths from ``anchor`` rows, one hop per step.

    ``steps_from`` gives the direct dependencies of the jobs a frontier ends at.
    """
    frontier, count = folder.write(anchor, "paths/recursion_level=1")
    level = 1
    while count and level < max_level:
        front = frontier.withColumn("recursion_level", F.lit(level))
        steps = steps_from(frontier).withColumn("recursion_level", F.lit(1))
        level += 1
        frontier, count = folder.write(
            _extended(front, steps, guard).drop("recursion_level"),
            f"paths/recursion_level={level}",
        )
    return folder.read(_with_level(anchor.schema), "paths")


def _walk_doubling(
    direct: DataFrame, folder: StagedFolder, max_level: int, guard: str
) -> DataFrame:
    """Guarded paths from every job, in a number of joins logarithmic in ``max_level``.

    Once all paths up to ``k`` hops are known, a path of ``k + j`` hops is
    exactly one path of ``k`` hops followed by one of ``j`` hops, so each round
    doubles the length: ten levels take four joins.
    """
    _, count = folder.write(direct, "paths/recursion_level=1")
    schema = _with_level(direct.schema)
    reach = 1
    while count and reach < max_level:
        known = folder.read(schema, "paths")
        longest = min(2 * reach, max_level)
        step = _extended(
            known.filter(F.col("recursion_level") == reach),
            known.filter(F.col("recursion_level") <= longest - reach),
            guard,
        )
        seen = Observation()
        step.observe(
            seen, F.count_if(F.col("recursion_level") == longest).alias("rows")
        ).write.mode("append").partitionBy("recursion_level").parquet(f"{folder.root}/paths")
        count = int(seen.get["rows"])
        reach = longest
    return folder.read(schema, "paths")


def _report(rows: DataFrame) -> DataFrame:
    return rows.select(
        *_SUCCESSOR,
        composite_key("in_parent_table_id", "in_job_id").alias("in_table_job_id"),
        "out_condition",
        *_PREDECESSOR,
        composite_key("dependent_table_id", "dependent_job_id").alias("out_table_job_id"),
        "recursion_level",
        _path().alias("dependency_path"),
    )


def dependency_paths(
    consumes: DataFrame,
    produces: DataFrame,
    anchor_folders: Sequence[str] | None = None,
    anchor_like: str | None = None,
    max_level: int = 10,
    guard: str = "substring",
    match_cyclic: bool = False,
) -> DataFrame:
    """Every dependency path up to ``max_level``, one row per path.

    Rows keep their multiplicity (union-all semantics). Without an anchor all
    jobs start a path, so known paths extend each other and the length doubles
    per join. With an anchor only paths the anchor reaches are walked, one hop
    per join.
    """
    folder = StagedFolder(consumes.sparkSession, "closure")
    if anchor_folders is None and anchor_like is None:
        direct = direct_dependencies(consumes, produces, match_cyclic)
        return _report(_walk_doubling(direct, folder, max_level, guard))
    consumes, _ = folder.write(consumes, "consumes")
    produces, _ = folder.write(produces, "produces")

    def steps_from(frontier: DataFrame) -> DataFrame:
        # Only consumers the walk stands at meet the producers.
        reached = frontier.select(F.col("dependent_job").alias("job")).distinct()
        return direct_dependencies(
            consumes.join(reached, "job", "left_semi"), produces, match_cyclic
        )

    start = direct_dependencies(
        anchored(consumes, anchor_folders, anchor_like), produces, match_cyclic
    )
    return _report(_walk_stepwise(start, steps_from, folder, max_level, guard))


def in_display_order(paths: DataFrame) -> DataFrame:
    """Rows by successor and level, for a reader: a global sort. No later step needs it."""
    return paths.orderBy("in_job_name", "recursion_level", "dependency_path")


def shortest_edges(paths: DataFrame) -> DataFrame:
    """One edge per (successor, predecessor, condition): the least (level, path).

    Order-free, so it equals first-wins over rows sorted by level.
    """
    return (
        paths.groupBy(*EDGE_KEYS)
        .agg(F.min(F.struct("recursion_level", "dependency_path")).alias("_best"))
        .select(*EDGE_KEYS, "_best.recursion_level", "_best.dependency_path")
    )


def _visits(
    first: DataFrame,
    name_hops: DataFrame,
    folder: StagedFolder,
    part: str,
    keys: Sequence[str],
    avoided: Sequence[str],
    max_level: int,
    inside: DataFrame | None = None,
) -> DataFrame:
    """(keys, _at, _path, _ends, _level): the least path from each start to each name it reaches.

    ``first`` holds the names one hop away. The walk is breadth first and never
    enters a name in the ``avoided`` columns. A shortest path repeats no name.
    ``_ends`` comes with the hop to a name, see :func:`_plain_ends`.

    With ``inside`` (_outer, _inners), a name also bars those that lie inside
    it. A place is then a name and the set of names barred on the way there
    (``_barred``), and is left out if that name was reached in fewer hops with
    no more barred: whatever goes on from there goes on from the nearer place.
    """
    frontier, count = folder.write(first, f"{part}/_level=1")
    schema = T.StructType([*first.schema.fields, T.StructField("_level", T.IntegerType())])
    place = [*keys, "_at"]
    level = 1
    while count and level < max_level:
        level += 1
        onward = frontier.join(name_hops, F.col("_at") == F.col("_from"))
        for name in avoided:
            onward = onward.filter(F.col("_to") != F.col(name))
        onward = onward.drop("_ends").withColumnRenamed("_hop_ends", "_ends")
        path = F.concat("_path", F.lit(ARROW), "_to")
        if inside is None:
            reached = onward.select(*keys, F.col("_to").alias("_at"), path.alias("_path"), "_ends")
            fresh = _unvisited(reached, folder.read(schema, part), place)
        else:
            onward = onward.filter(~F.array_contains("_barred", F.col("_to")) & ~_on_path("_to"))
            onward = _barring(onward, inside, "_to")
            least = F.min(F.struct(path.alias("_path"), "_ends")).alias("_least")
            reached = onward.groupBy(*keys, F.col("_to").alias("_at"), "_barred").agg(least)
            reached = reached.select(*place, "_barred", "_least.*")
            seen = folder.read(schema, part).select(*place, F.col("_barred").alias("_less"))
            reached, seen = reached.alias("r"), seen.alias("s")
            same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in place]
            fewer = F.size(F.array_except(F.col("s._less"), F.col("r._barred"))) == 0
            fresh = reached.join(seen, [*same, fewer], "left_anti").select(first.columns)
        frontier, count = folder.write(fresh, f"{part}/_level={level}")
    return folder.read(schema, part)


def _unvisited(reached: DataFrame, visits: DataFrame, place: Sequence[str]) -> DataFrame:
    """The least of the paths to each place not in ``visits``.

    Places seen before join the same grouping, without their paths, so paths
    are moved and sorted once.
    """
    seen = visits.select(*place, *[F.lit(None).cast(reached.schema[c].dataType).alias(c) for c in ("_path", "_ends")])
    least = F.min(F.when(F.col("_path").isNotNull(), F.struct("_path", "_ends"))).alias("_least")
    both = reached.unionByName(seen).repartition(*place[:-1])
    found = both.groupBy(*place).agg(least, F.bool_or(F.col("_path").isNull()).alias("_seen"))
    return found.filter(~F.col("_seen")).select(*place, "_least.*")


def _visits_between_names(
    first: DataFrame, folder: StagedFolder, part: str, max_level: int
) -> DataFrame:
    """:func:`_visits` where each start has a name of its own and all names that lead on are among the starts.

    A path of some hops is a first hop and then a path of one hop less from
    there, which is known: so visits move by their start, where neighbouring
    rows share most of their text and take little room, and not by their end.
    """
    frontier, count = folder.write(first, f"{part}/_level=1")
    schema = T.StructType([*first.schema.fields, T.StructField("_level", T.IntegerType())])
    hops = frontier.select(*_START, F.col("_at").alias("_via"))
    level = 1
    while count and level < max_level:
        level += 1
        further = frontier.select(
            F.col("in_job_name").alias("_via"), "_at", F.col("_path").alias("_rest"), "_ends"
        )
        path = F.concat("in_job_name", F.lit(ARROW), "_rest").alias("_path")
        reached = hops.join(further, "_via").filter(F.col("_at") != F.col("in_job_name"))
        fresh = _unvisited(
            reached.select(*_START, "_at", path, "_ends"), folder.read(schema, part), [*_START, "_at"]
        )
        frontier, count = folder.write(fresh, f"{part}/_level={level}")
    return folder.read(schema, part)


def _visits_from_all(
    first: DataFrame, name_hops: DataFrame, folder: StagedFolder, max_level: int
) -> DataFrame:
    """:func:`_visits` where every job starts.

    Jobs that share their name walk on their own: the way on from a name is
    that of all its jobs, and may lead through the name again for one of them.
    """
    jobs = first.select(*_START).distinct().groupBy("in_job_name").agg(F.count(F.lit(1)).alias("_jobs"))
    shared, number = folder.write(jobs.filter(F.col("_jobs") > 1).select("in_job_name"), "shared")
    if not number:
        return _visits_between_names(first, folder, "visits", max_level)
    several = first.join(shared, "in_job_name", "left_semi").select(first.columns)
    alone = first.join(shared, "in_job_name", "left_anti").select(first.columns)
    # The hops of a shared name, under no job, serve those who come by.
    mark = F.lit(None).cast("string")
    by_name = name_hops.join(shared, F.col("_from") == F.col("in_job_name"), "left_semi").select(
        mark.alias("in_parent_table_id"), mark.alias("in_job_id"), F.col("_from").alias("in_job_name"),
        F.col("_to").alias("_at"), F.concat("_from", F.lit(ARROW), "_to").alias("_path"), F.col("_hop_ends").alias("_ends"),
    )
    names = _visits_between_names(alone.unionByName(by_name), folder, "visits", max_level)
    own = _visits(several, name_hops, folder, "several", _START, ["in_job_name"], max_level)
    return names.join(shared, "in_job_name", "left_anti").select(own.columns).unionByName(own)


#: Conditions and jobs that a name may bring along on a walk.
_MOST_ENDS = 16


def _plain_ends(direct: DataFrame, first: DataFrame) -> DataFrame:
    """(_at, _ends): names that all who wait for them wait for alike, with their (condition, job) pairs.

    Each visit of such a name is an edge of each pair, at the visit's level and
    with its path: no other way to the pair is nearer. A job with several names
    has no such name, nor has a name with many pairs.
    """
    pairs = direct.select(*_START, "out_condition", *_PREDECESSOR[1:]).distinct()
    job = ["dependent_table_id", "dependent_job_id"]
    ends = pairs.groupBy("dependent_job", "out_condition", *job).agg(F.count(F.lit(1)).alias("_waiting"))
    several = ends.groupBy(*job).agg((F.min("dependent_job") == F.max("dependent_job")).alias("_one_name"))
    starts = first.groupBy(F.col("_at").alias("dependent_job")).agg(F.count(F.lit(1)).alias("_starts"))
    marked = ends.join(several, job, "left").join(starts, "dependent_job", "left")
    alike = F.coalesce(F.col("_one_name") & (F.col("_waiting") == F.col("_starts")), F.lit(False))
    plain = marked.groupBy("dependent_job").agg(F.bool_and(alike).alias("_plain"), F.count(F.lit(1)).alias("_number"))
    plain = plain.filter(F.col("_plain") & (F.col("_number") <= _MOST_ENDS)).select("dependent_job")
    pair = F.struct("dependent_table_id", "dependent_job_id", "out_condition")
    return (
        ends.join(plain, "dependent_job", "left_semi")
        .groupBy(F.col("dependent_job").alias("_at"))
        .agg(F.array_sort(F.collect_list(pair)).alias("_ends"))
    )


def _on_path(name: str) -> Column:
    """Whether a name is found between the arrows of ``_path``; one found in error costs a walk, not a row."""
    whole = F.concat(F.lit(ARROW), "_path", F.lit(ARROW))
    return F.instr(whole, F.concat(F.lit(ARROW), name, F.lit(ARROW))) > 0


def _barring(rows: DataFrame, inside: DataFrame, name: str) -> DataFrame:
    """``_barred`` with the names inside the one in ``name``, in order and each once."""
    both = F.concat("_barred", F.coalesce("_inners", F.array().cast("array<string>")))
    met = rows.join(inside, F.col(name) == F.col("_outer"), "left")
    return met.withColumn("_barred", F.array_sort(F.array_distinct(both))).drop("_outer", "_inners")


def _first_barred(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """What the two names of a first hop bar."""
    empty = rows.withColumn("_barred", F.array().cast("array<string>"))
    return _barring(_barring(empty, inside, "in_job_name"), inside, "_at")


def _meets_arrow(name: str) -> Column:
    """Whether the substring guard could find a name across the arrows of a path."""
    column = F.col(name)
    ends = [ARROW[:n] for n in range(1, len(ARROW))]
    begins = [ARROW[n:] for n in range(1, len(ARROW))]
    met = column.contains(ARROW) | (F.instr(F.lit(ARROW), column) > 0)
    for text in ends:
        met = met | column.endswith(text)
    for text in begins:
        met = met | column.startswith(text)
    return met


#: Letters of the pieces by which names are looked up in one another: fewer would be in too many names.
_PIECE = 8


def _names_inside(names: DataFrame) -> DataFrame:
    """(_outer, _inner) of the ``name`` values that lie inside others.

    A name is looked up by the one of its pieces that the fewest names hold,
    and each name that holds the piece is then searched for it. So a name costs
    its length, and a piece that all names share leads nowhere. Names of one
    length are not inside one another, and none is taken apart.
    """
    length = F.char_length("name")
    names = names.filter(length > 0)
    found = names.agg(F.min(length), F.max(length), F.collect_set(F.least(length, F.lit(_PIECE)))).first()
    if found[0] == found[1]:
        return names.select(F.col("name").alias("_outer"), F.col("name").alias("_inner")).limit(0)
    sizes = F.array(*[F.lit(n) for n in sorted(found[2])])
    fitting = F.filter(sizes, lambda n: n <= F.char_length("name"))
    sized = names.select("name", F.explode(fitting).alias("_size"))
    begins = F.sequence(F.lit(1), F.char_length("name") - F.col("_size") + 1)
    pieces = (
        sized.select("name", "_size", F.explode(begins).alias("_begin"))
        .select("name", "_size", F.substring("name", F.col("_begin"), F.col("_size")).alias("_piece"))
        .distinct()
    )
    held = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_held"))
    own = pieces.filter(F.col("_size") == F.least(F.char_length("name"), F.lit(_PIECE)))
    rarest = own.join(held, "_piece").groupBy("name").agg(F.min(F.struct("_held", "_piece")).alias("_best"))
    looked = rarest.select(F.col("name").alias("_inner"), F.col("_best._piece").alias("_piece"))
    met = pieces.select(F.col("name").alias("_outer"), "_piece").join(looked, "_piece")
    found = (F.col("_outer") != F.col("_inner")) & (F.instr("_outer", F.col("_inner")) > 0)
    return met.filter(found).select("_outer", "_inner")


def _names_barred(
    visits: DataFrame, name_hops: DataFrame, folder: StagedFolder, max_level: int, every_job_starts: bool
) -> DataFrame:
    """(_outer, _inner) of names of which the outer one leads to the inner one; others bar nothing."""
    named = visits.select(F.col("_at").alias("name")).union(visits.select("in_job_name")).distinct()
    if every_job_starts:
        within = visits.select(F.col("in_job_name").alias("_outer"), F.col("_at").alias("_inner")).distinct()
        return within.filter((F.col("_outer") != F.col("_inner")) & (F.instr("_outer", F.col("_inner")) > 0))
    pairs, number = folder.write(_names_inside(named), "pairs")
    if not number:
        return pairs
    hops = name_hops.select(F.col("_from").alias("_outer"), F.col("_to").alias("_inner"))
    reach = bounded_reach(hops, "_outer", "_inner", max_level, pairs.select("_outer"))
    return pairs.join(reach.select("_outer", "_inner"), ["_outer", "_inner"], "left_semi")


def _hidden_starts(visits: DataFrame, inside: DataFrame) -> DataFrame:
    """Starts on whose paths the substring guard may stop at a name unlike all before it.

    Such a path holds a name and, later, one that lies inside it.
    """
    own = visits.select(*_START, F.col("in_job_name").alias("_at")).distinct()
    reach = visits.select(*_START, "_at").union(own)
    return (
        reach.join(inside, F.col("_at") == F.col("_outer"))
        .select(*_START, F.col("_inner").alias("_at"))
        .join(visits.select(*_START, "_at"), [*_START, "_at"], "left_semi")
        .select(*_START)
        .distinct()
    )


def dependency_edges(
    consumes: DataFrame,
    produces: DataFrame,
    max_level: int = 10,
    guard: str = "substring",
    match_cyclic: bool = False,
    anchor_folders: Sequence[str] | None = None,
    anchor_like: str | None = None,
) -> DataFrame:
    """The edges of :func:`shortest_edges` without listing every path.

    The number of paths can grow exponentially with the level, the number of
    edges cannot. So each successor walks breadth first and visits every job
    name once, keeping its least path. One join of all visits with the direct
    dependencies gives the edges: a last hop is certain unless its target lies
    on the stored path. Where no certain edge is nearer, such a target is left
    out and the walk repeated for that successor, which gives the least path
    around it.

    That is exact while the guard compares whole names. The substring guard
    differs only for successors that reach a name and another one inside it;
    those visit a name once per set of names barred on the way. Paths are listed
    only for successors that reach a name which the guard could find across the
    arrows of a path. With an anchor only the chosen successors start a walk.
    """
    if guard not in ("substring", "exact"):
        raise ValueError(f"unknown guard {guard!r}")
    folder = StagedFolder(consumes.sparkSession, "edges")
    direct, _ = folder.write(direct_dependencies(consumes, produces, match_cyclic), "direct")
    every_job_starts = anchor_folders is None and anchor_like is None
    chosen = anchored(
        direct.withColumn("folder", F.col("in_parent_table")), anchor_folders, anchor_like
    ).drop("folder")
    reached = [*_START, F.col("dependent_job").alias("_at")]
    ends, _ = folder.write(_plain_ends(direct, direct.select(*reached).distinct()), "ends")
    name_hops = direct.select(
        F.col("in_job_name").alias("_from"), F.col("dependent_job").alias("_at")
    ).distinct()
    name_hops = name_hops.join(ends, "_at", "left").select(
        "_from", F.col("_at").alias("_to"), F.col("_ends").alias("_hop_ends")
    )
    name_hops, _ = folder.write(name_hops, "hops")
    first = chosen.groupBy(*reached).agg(F.min(_path()).alias("_path")).join(ends, "_at", "left")
    first = first.select(*_START, "_at", "_path", "_ends")
    if every_job_starts:
        visits = _visits_from_all(first, name_hops, folder, max_level)
    else:
        visits = _visits(first, name_hops, folder, "visits", _START, ["in_job_name"], max_level)

    rows = [*EDGE_KEYS, "recursion_level", "dependency_path"]
    parts, barred, inside = [], None, None
    job = ["in_parent_table_id", "in_job_id"]
    renamed = chosen.groupBy(*job).agg((F.min("in_job_name") != F.max("in_job_name")).alias("_several"))
    renamed, several = folder.write(renamed.filter("_several").select(*job), "renamed")
    every = visits
    if guard == "substring":
        met, number = folder.write(name_hops.filter(_meets_arrow("_to")).select(F.col("_to").alias("_at")).distinct(), "met")
        if number:
            arrows = visits.join(met, "_at", "left_semi").select(*_START).distinct()
            arrows, number = folder.write(arrows, "arrows")
        if number:
            listed = _walk_stepwise(
                chosen.join(arrows, list(_START), "left_semi"), lambda _: direct, folder, max_level, guard
            )
            parts.append(listed.withColumn("dependency_path", _path()).select(*rows))
            chosen = chosen.join(arrows, list(_START), "left_anti")
            first = first.join(arrows, list(_START), "left_anti")
            visits = visits.join(arrows, list(_START), "left_anti")
        pairs, number = folder.write(_names_barred(every, name_hops, folder, max_level, every_job_starts), "inside")
        hidden, number = folder.write(_hidden_starts(visits, pairs), "hidden") if number else (None, 0)
        if number:
            inside = pairs.groupBy("_outer").agg(F.array_sort(F.collect_set("_inner")).alias("_inners"))
            inside, _ = folder.write(inside, "inners")
            begun = first.join(hidden, list(_START), "left_semi")
            barred = _visits(
                _first_barred(begun, inside), name_hops, folder, "barred", _START, ["in_job_name"], max_level, inside
            )
            visits = visits.join(hidden, list(_START), "left_anti")

    # Visits of plain names are edges as they are, unless their job starts under several names.
    plain = _edges_of_visits(visits)
    if several:
        parts.append(plain.join(renamed, job, "left_semi"))
        plain = plain.join(renamed, job, "left_anti")
    if barred is not None:
        parts.append(_edges_of_visits(barred))
    visits = visits.withColumn("_barred", F.array().cast("array<string>"))
    if barred is not None:
        visits = visits.unionByName(barred)
    hops = direct.select(
        F.col("in_job_name").alias("_from"), "out_condition", *_PREDECESSOR[1:]
    ).distinct()
    known = F.col("dependent_job") == F.col("_at")
    hops, number = folder.write(hops.join(ends.select("_at"), known, "left_anti"), "other-hops")
    if number:
        near = chosen.join(ends.select("_at"), known, "left_anti")
        parts += _edges_of_hops(near, first, visits, hops, name_hops, folder, max_level, hidden if barred is not None else None, inside)
    if not parts:
        return plain.select(*rows)
    together = parts[0].select(*rows)
    for part in parts[1:]:
        together = together.unionByName(part.select(*rows))
    return plain.select(*rows).unionByName(shortest_edges(together))


def _edges_of_visits(visits: DataFrame) -> DataFrame:
    """An edge of each visit to each pair its name has brought along."""
    return visits.select(
        "in_parent_table_id", "in_job_id", F.inline("_ends"),
        F.col("_level").alias("recursion_level"), F.col("_path").alias("dependency_path"),
    )


def _edges_of_hops(
    chosen: DataFrame,
    first: DataFrame,
    visits: DataFrame,
    hops: DataFrame,
    name_hops: DataFrame,
    folder: StagedFolder,
    max_level: int,
    hidden: DataFrame | None,
    inside: DataFrame | None,
) -> list[DataFrame]:
    """Edges over the last hops in ``hops``, and those of ``chosen`` that are one hop long."""
    far = (
        visits.filter(F.col("_level") < max_level)
        .join(hops, F.col("_at") == F.col("_from"))
        .filter(F.col("dependent_job") != F.col("in_job_name"))
        .filter(~F.array_contains("_barred", F.col("dependent_job")))
        .select(
            *EDGE_KEYS,
            "in_job_name",
            "dependent_job",
            (F.col("_level") + 1).alias("recursion_level"),
            F.concat("_path", F.lit(ARROW), "dependent_job").alias("dependency_path"),
            _on_path("dependent_job").alias("_doubtful"),
        )
    )
    near = chosen.select(
        *EDGE_KEYS,
        "in_job_name",
        "dependent_job",
        F.lit(1).alias("recursion_level"),
        _path().alias("dependency_path"),
        F.lit(False).alias("_doubtful"),
    )
    found = near.unionByName(far).groupBy(*EDGE_KEYS).agg(
        F.min(F.when(~F.col("_doubtful"), F.struct("recursion_level", "dependency_path"))).alias("_best"),
        F.min(F.when(F.col("_doubtful"), F.col("recursion_level"))).alias("_doubt"),
    )
    # A doubtful edge is at this level at least.
    is_open = F.col("_doubt").isNotNull() & (
        F.col("_best").isNull() | (F.col("_best.recursion_level") >= F.col("_doubt"))
    )
    found, _ = folder.write(found.withColumn("_open", is_open), "found")
    certain = found.filter(F.col("_best").isNotNull()).select(
        *EDGE_KEYS, "_best.recursion_level", "_best.dependency_path"
    )
    open_edges = found.filter("_open").select(*EDGE_KEYS)
    around = far.filter("_doubtful").join(open_edges, list(EDGE_KEYS), "left_semi")
    around, number = folder.write(
        around.select(*_START, F.col("dependent_job").alias("_avoid")).distinct(), "around"
    )
    if not number:
        return [certain]
    free = around if hidden is None else around.join(hidden, list(_START), "left_anti")
    parts = [certain, _edges_around(first, free, hops, name_hops, folder, max_level, "detours")]
    if hidden is not None:
        held = around.join(hidden, list(_START), "left_semi")
        parts.append(_edges_around(first, held, hops, name_hops, folder, max_level, "held", inside))
    return parts


def _edges_around(
    first: DataFrame,
    around: DataFrame,
    hops: DataFrame,
    name_hops: DataFrame,
    folder: StagedFolder,
    max_level: int,
    part: str,
    inside: DataFrame | None = None,
) -> DataFrame:
    """Edges to each ``_avoid`` name over the least paths that do not pass it before, nor bar it."""
    keys = (*_START, "_avoid")
    first = first.join(around, list(_START)).filter(F.col("_at") != F.col("_avoid"))
    first = first.select(*keys, "_at", "_path", "_ends")
    if inside is not None:
        first = _first_barred(first, inside)
    visits = _visits(first, name_hops, folder, part, keys, ["in_job_name", "_avoid"], max_level, inside)
    if inside is not None:
        visits = visits.filter(~F.array_contains("_barred", F.col("_avoid")))
    last = (F.col("_at") == F.col("_from")) & (F.col("_avoid") == F.col("dependent_job"))
    return visits.filter(F.col("_level") < max_level).join(hops, last).select(
        *EDGE_KEYS,
        (F.col("_level") + 1).alias("recursion_level"),
        F.concat("_path", F.lit(ARROW), "dependent_job").alias("dependency_path"),
    )


def composite_key(*parts: str) -> Column:
    """Display key such as ``folder_id.job_id``."""
    return F.concat_ws(".", *parts)
