"""Integrity checks: each is one aggregated row of (check, ok, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.identifiers import LOCAL_NAMESPACE


def _result(df: DataFrame, name: str, ok: Column, **numbers: str) -> DataFrame:
    detail = [
        x for label, column in numbers.items() for x in (F.lit(f"{label}="), F.col(column))
    ]
    spaced = []
    for i in range(0, len(detail), 2):
        spaced.append(F.concat(detail[i], detail[i + 1].cast("string")))
    return df.select(
        F.lit(name).alias("check"), ok.alias("ok"), F.concat_ws(" ", *spaced).alias("detail")
    )


def every_row_linked(
    rows: DataFrame, links: DataFrame, on: Sequence[str], name: str,
    labels: tuple[str, str] = ("rows", "linked"),
) -> DataFrame:
    """Every row has at least one link.

    Counts the rows of the optional match (a row with several links counts for
    each), from links reduced to a count per key.
    """
    per_key = links.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    found = F.coalesce("_n", F.lit(0))
    counted = rows.select(*on).join(per_key, list(on), "left").agg(
        F.coalesce(F.sum(F.greatest(found, F.lit(1))), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum(found), F.lit(0)).alias("_links"),
    )
    ok = F.col("_rows") == F.col("_links")
    return _result(counted, name, ok, **{labels[0]: "_rows", labels[1]: "_links"})


def no_duplicates(rows: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """No key occurs more than once."""
    groups = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _result(groups.agg(F.count(F.lit(1)).alias("_d")), name, F.col("_d") == 0, dupes="_d")


def present_once(rows: DataFrame, name: str, label: str = "n") -> DataFrame:
    return _result(
        rows.agg(F.count(F.lit(1)).alias("_n")), name, F.col("_n") == 1, **{label: "_n"}
    )


def local_terms_seeded(
    terms: DataFrame,
    name: str = "local anchor terms seeded",
    namespace: str = LOCAL_NAMESPACE,
    endings: Sequence[str] = ("JobFolder", "ControlMJob", "ControlMServer"),
    at_least: int = 3,
) -> DataFrame:
    """Terms of the local namespace with one of the expected endings."""
    iri = F.col("iri")
    ends = reduce(lambda a, b: a | b, [iri.endswith(e) for e in endings])
    found = terms.filter((F.col("source_label") == "LocalClass") & iri.startswith(namespace) & ends)
    counted = found.agg(F.countDistinct("iri").alias("_n"))
    return _result(counted, name, F.col("_n") >= at_least, n="_n")


def no_empty_parents(
    parents: DataFrame, links: DataFrame, on: Sequence[str], name: str
) -> DataFrame:
    """No parent without a child, counted in two levels."""
    per_parent = links.groupBy(*on).agg(F.count(F.lit(1)).alias("_children"))
    counted = parents.select(*on).join(per_parent, list(on), "left").agg(
        F.count_if(F.coalesce("_children", F.lit(0)) == 0).alias("_empty"),
        F.count(F.lit(1)).alias("_total"),
    )
    return _result(counted, name, F.col("_empty") == 0, empty="_empty", total="_total")


def no_orphans(
    rows: DataFrame, references: Sequence[DataFrame], on: Sequence[str], name: str
) -> DataFrame:
    """Every row is referenced by at least one of several edge types."""
    used = reduce(
        DataFrame.unionByName, [r.select(*on) for r in references]
    ).distinct().withColumn("_used", F.lit(1))
    counted = rows.select(*on).join(used, list(on), "left").agg(
        F.count_if(F.col("_used").isNull()).alias("_orphan"), F.count(F.lit(1)).alias("_total")
    )
    return _result(counted, name, F.col("_orphan") == 0, orphan="_orphan", total="_total")


def edges_complete(edges: DataFrame, name: str) -> DataFrame:
    """Derived edges carry a level and a path."""
    counted = edges.filter("derived").agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(F.col("recursion_level").isNull()).alias("_level"),
        F.count_if(F.col("dependency_path").isNull()).alias("_path"),
    )
    ok = (F.col("_level") == 0) & (F.col("_path") == 0)
    return _result(
        counted, name, ok, total="_total", missing_level="_level", missing_path="_path"
    )


def both_ports(applications: DataFrame, ports: DataFrame, name: str) -> DataFrame:
    """Every application has one port of each kind."""
    kinds = ports.groupBy(F.col("parent_seal_id").alias("seal_id")).agg(
        F.count_if(F.col("kind") == "EventProcessing").alias("_event"),
        F.count_if(F.col("kind") == "BatchProcessing").alias("_batch"),
    )
    counted = applications.select("seal_id").join(kinds, "seal_id", "left").agg(
        F.count(F.lit(1)).alias("_apps"),
        F.coalesce(F.sum("_event"), F.lit(0)).alias("_ep"),
        F.coalesce(F.sum("_batch"), F.lit(0)).alias("_bp"),
    )
    ok = (F.col("_apps") == F.col("_ep")) & (F.col("_apps") == F.col("_bp"))
    return _result(counted, name, ok, apps="_apps", ep="_ep", bp="_bp")


def has_null(keys: Sequence[str]) -> Column:
    """Some part of the key is NULL."""
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def key_report(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with a NULL in the key, and keys held by several rows."""
    null_key = has_null(keys)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).cast("bigint").alias("null_keys"),
        F.count_if(~null_key & (F.col("_n") > 1)).alias("duplicate_keys"),
    ).select(F.lit(name).alias("check"), "null_keys", "duplicate_keys")


def check_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A declared key holds: no NULL part, no duplicate."""
    return key_verdict(key_report(df, keys, name), name)


def key_verdict(report: DataFrame, name: str) -> DataFrame:
    """The check that a report of a key amounts to."""
    ok = (F.col("null_keys") == 0) & (F.col("duplicate_keys") == 0)
    return _result(report, name, ok, nulls="null_keys", dupes="duplicate_keys")


def edge_registry_gaps(observed: DataFrame, registry: DataFrame) -> DataFrame:
    """Observed (edge type, from, to) triples the registry does not declare.

    A registry endpoint ``*`` allows any label.
    """
    declared = registry.filter(F.col("status") == "active").select(
        F.col("edge_type").alias("_type"),
        F.col("from_node").alias("_from"),
        F.col("to_node").alias("_to"),
    )
    matches = (
        (F.col("edge_type") == F.col("_type"))
        & ((F.col("_from") == "*") | (F.col("from_node") == F.col("_from")))
        & ((F.col("_to") == "*") | (F.col("to_node") == F.col("_to")))
    )
    return observed.join(declared, matches, "left_anti")


def registry_conforms(observed: DataFrame, registry: DataFrame, name: str) -> DataFrame:
    gaps = edge_registry_gaps(observed, registry)
    return _result(
        gaps.agg(F.count(F.lit(1)).alias("_n")), name, F.col("_n") == 0, undeclared="_n"
    )


@dataclass(frozen=True)
class EdgeEnds:
    """What the rows of an edge table claim: their type, and each end's label and key.

    Keys are {edge column: key column of the node}.
    """

    edge_type: str
    from_node: str
    from_on: Mapping[str, str]
    to_node: str
    to_on: Mapping[str, str]


def _with_end(
    edges: DataFrame, nodes: DataFrame, on: Mapping[str, str], label: str, into: str
) -> DataFrame:
    keys = nodes.select(*[F.col(k).alias(f"_key_{c}") for c, k in on.items()]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_key_{c}") for c in on])
    found = edges.join(keys.withColumn(into, F.lit(label)), same, "left")
    return found.drop(*[f"_key_{c}" for c in on])


def edge_census(
    edges: DataFrame, ends: EdgeEnds, from_nodes: DataFrame, to_nodes: DataFrame
) -> DataFrame:
    """Edges per type and what their ends resolve to: the label, or NULL where no node has the key.

    Every row counts, repeated ones too; a key with a NULL resolves to no node.
    Only key columns are read, and no edges give no row.
    """
    keys = edges.select(*[F.col(c) for c in dict.fromkeys([*ends.from_on, *ends.to_on])])
    resolved = _with_end(keys, from_nodes, ends.from_on, ends.from_node, "from_node")
    resolved = _with_end(resolved, to_nodes, ends.to_on, ends.to_node, "to_node")
    counted = resolved.groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("edges"))
    return counted.select(F.lit(ends.edge_type).alias("edge_type"), "from_node", "to_node", "edges")


def edge_findings(
    census: DataFrame, registry: DataFrame, matrix: DataFrame, kinds: DataFrame
) -> DataFrame:
    """What the edges of a census break, a row per type, ends and rule.

    ``stray``: an end that no node has. ``undeclared``: resolved ends that no
    active registry entry allows. ``off_matrix``: the type maps to a term of the
    matrix (rows of from_type, to_type, term), which links other kinds of node;
    ``kinds`` gives the kinds of a label, a label without any is of none. Ends
    ``*`` of the registry and ``any`` of the matrix allow every resolved end.
    """
    columns = ["edge_type", "from_node", "to_node", "edges"]
    lost = F.col("from_node").isNull() | F.col("to_node").isNull()
    resolved = census.filter(~lost)

    def kind(end: str) -> DataFrame:
        return kinds.select(F.col("label").alias(f"{end}_node"), F.col("kind").alias(f"_{end}"))

    terms = registry.filter("status = 'active'").select("edge_type", "term").distinct()
    ruled = resolved.join(terms, "edge_type").join(matrix.select("term", "from_type", "to_type"), "term")
    ruled = ruled.join(kind("from"), "from_node", "left").join(kind("to"), "to_node", "left")
    fits = [
        (F.col(f"{end}_type") == "any") | F.col(f"{end}_type").eqNullSafe(F.col(f"_{end}"))
        for end in ("from", "to")
    ]
    off = ruled.groupBy(*columns).agg(F.bool_or(fits[0] & fits[1]).alias("_fits")).filter("NOT _fits")
    found = {
        "stray": census.filter(lost),
        "undeclared": edge_registry_gaps(resolved, registry),
        "off_matrix": off,
    }
    return reduce(
        DataFrame.unionByName,
        [rows.select(*columns, F.lit(rule).alias("finding")) for rule, rows in found.items()],
    )


def no_findings(findings: DataFrame, rule: str, name: str) -> DataFrame:
    """No edge breaks one rule of :func:`edge_findings`."""
    counted = findings.filter(F.col("finding") == rule).agg(
        F.count(F.lit(1)).alias("_types"), F.coalesce(F.sum("edges"), F.lit(0)).alias("_edges")
    )
    return _result(counted, name, F.col("_types") == 0, types="_types", edges="_edges")


def label_counts(rows: DataFrame, labels: Column, skip: Sequence[str] = ()) -> DataFrame:
    """Rows per label of a multi-label column, one label left out."""
    exploded = rows.select(F.explode(labels).alias("source_label"))
    if skip:
        exploded = exploded.filter(~F.col("source_label").isin(*skip))
    return exploded.groupBy("source_label").agg(F.count(F.lit(1)).alias("terms"))


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def overall(checks: DataFrame) -> DataFrame:
    """One row: whether every check passed, and how many failed."""
    return checks.agg(
        F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")
    )


def check_declared_keys(
    tables: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, Sequence[str]]]
) -> DataFrame:
    """One check per declared key whose table exists."""
    return report(
        [
            check_key(tables[table], columns, f"key {name}")
            for name, (table, columns) in keys.items()
            if table in tables
        ]
    )
