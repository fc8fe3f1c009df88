"""Chains of loads in the order their parents need."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.identifiers import LOCAL_NAMESPACE
from jobweave.operators import closure, history, quality
from jobweave.operators.upsert import Merge, rename_keys, upsert
from jobweave.plans.loads import DEPENDENCIES, LOADS, run_load
from jobweave.session import RunClock
from jobweave.sinks.runs import RUN_TABLE, LoadSummary, RunLog
from jobweave.sinks.tables import TableSet
from jobweave.sinks.together import run_together
from jobweave.sinks.versions import VersionTable
from jobweave.sources import specs, vocabulary
from jobweave.sources.files import path_exists, stage
from jobweave.sources.readers import Source, literal_table, with_sequence

REFERENCE_STAGES = (
    "catalog_lobs", "product_lines", "products", "seal_applications", "seal_contacts", "dev_teams",
)
SCHEDULER_STAGES = (
    "controlm_folders", "controlm_jobs", "controlm_conditions_in", "controlm_conditions_out",
)
SUPPLEMENTS = ("scheduler", "applications", "catalog")


def load_table(
    name: str,
    source: Source,
    tables: TableSet,
    clock: RunClock | None = None,
    source_label: str | None = None,
) -> LoadSummary:
    """One registered load by name."""
    if not source.exists(tables.spark):
        raise FileNotFoundError(f"no source for {name!r}: {source.location}")
    return run_load(
        LOADS[name], source.read(tables.spark), tables, clock or RunClock(), source_label
    )


def _merge_static(tables: TableSet, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
    rest = tuple(c for c in rows.columns if c not in keys)
    merge = Merge(tuple(keys), set_columns=rest)
    tables.write(name, upsert(tables.read_or_none(name), rows, merge, collapsed=True))


def _add_missing(tables: TableSet, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Rows whose key is not there yet; what is there keeps its create-only values."""
    rest = tuple(c for c in rows.columns if c not in keys)
    merge = Merge(tuple(keys), create_only=rest)
    tables.write(name, upsert(tables.read_or_none(name), rows, merge, collapsed=True))


def bootstrap(
    tables: TableSet,
    supplements: Sequence[str] = SUPPLEMENTS,
    namespace: str = LOCAL_NAMESPACE,
    update_role_names: bool = True,
) -> None:
    """Seed vocabularies, then the local supplements, then the role names. Safe to re-run."""
    spark = tables.spark
    current = vocabulary.segment_memberships(spark)
    former = vocabulary.segment_memberships(spark, historical=True)
    ends = ["company", "segment_code"]
    seeds = [
        (_merge_static, "ontology_term", vocabulary.published_terms(spark), ["iri"]),
        (_merge_static, "role", _plain_roles(tables), ["name"]),
        (_merge_static, "scheduler_kind", vocabulary.scheduler_kinds(spark), ["name"]),
        (_merge_static, "company", vocabulary.company(spark), ["name"]),
        (_merge_static, "business_segment", vocabulary.business_segments(spark), ["code"]),
        (_add_missing, "has_business_segment", current, ends),
        (_add_missing, "has_business_segment_historical", former, ends),
        (_merge_static, "dq_dimension", vocabulary.quality_dimensions(spark), ["name"]),
        (_merge_static, "dq_metric", vocabulary.quality_metrics(spark), ["name"]),
        (_add_missing, "in_dimension", vocabulary.metric_dimensions(spark), ["metric", "dimension"]),
        (_merge_static, "agent", vocabulary.loader_agent(spark), ["id"]),
    ]
    run_together(spark, [partial(merge, tables, *rest) for merge, *rest in seeds])
    for name in supplements:
        apply_supplement(tables, name, namespace)
    if update_role_names:
        update_roles(tables)


def _plain_roles(tables: TableSet) -> DataFrame:
    """Seed roles that are not stored under a newer name already."""
    seeds = vocabulary.seed_roles(tables.spark).select("name", "source", "description")
    stored = tables.read_or_none("role")
    if stored is None or "deprecated_name" not in stored.columns:
        return seeds
    renamed = stored.select(F.col("deprecated_name").alias("name")).filter(F.col("name").isNotNull())
    return seeds.join(renamed.distinct(), "name", "left_anti")


def apply_supplement(tables: TableSet, name: str, namespace: str = LOCAL_NAMESPACE) -> None:
    spark = tables.spark
    _merge_static(tables, "ontology_term", vocabulary.local_terms(spark, name, namespace), ["iri"])
    subclass, maps = vocabulary.term_links(spark, name, tables.read("ontology_term"), namespace)
    _add_missing(tables, "subclass_of", subclass, ["iri", "to_iri"])
    _add_missing(tables, "maps_to", maps, ["iri", "to_iri"])


def update_roles(tables: TableSet) -> None:
    """Rename seed roles where the new name is free, then merge the framework roles.

    Membership edges follow the rename, as they would with a renamed row.
    """
    spark = tables.spark
    roles = tables.read("role")
    for extra in ("mandatory", "spec_level", "spec_source", "deprecated_name", "effective_from"):
        if extra not in roles.columns:
            kind = {"mandatory": "boolean", "effective_from": "date"}.get(extra, "string")
            roles = roles.withColumn(extra, F.lit(None).cast(kind))
    renamed = stage(vocabulary.rename_roles(roles), "roles")
    if tables.exists("of_role"):
        done = {
            old: new
            for old, new in vocabulary.ROLE_RENAMES.items()
            if not renamed.filter((F.col("name") == new) & (F.col("deprecated_name") == old)).isEmpty()
        }
        if done:
            tables.write("of_role", rename_keys(tables.read("of_role"), "role_name", done))
    framework = vocabulary.framework_roles(spark)
    merge = Merge(("name",), set_columns=tuple(c for c in framework.columns if c not in ("name", "effective_from")),
                  keep_old=("effective_from",))
    tables.write("role", upsert(renamed, framework, merge, collapsed=True))


def refresh_reference(
    tables: TableSet,
    sources: Mapping[str, Source],
    clock: RunClock | None = None,
    snapshot: bool = True,
) -> dict[str, dict]:
    """Catalog, applications, contacts and teams in order; then snapshots.

    A missing source is skipped and reported; the chain goes on. The summary of
    the segments that are active now comes first, once they are seeded.
    """
    clock = clock or RunClock()
    results: dict[str, dict] = {}
    if tables.exists("has_business_segment"):
        current = tables.read("has_business_segment").select("segment_code").distinct()
        results["business_segments"] = history.active_segments(current).first().asDict()
    for name in REFERENCE_STAGES:
        source = sources.get(name)
        if source is None or not source.exists(tables.spark):
            results[name] = {"status": "skipped"}
            continue
        results[name] = load_table(name, source, tables, _stage_clock(clock)).as_dict()
    if snapshot:
        results["snapshots"] = write_snapshots(tables, clock)
    return results


def _stage_clock(clock: RunClock) -> RunClock:
    """Each load is a run of its own at the chain's time."""
    return RunClock(loaded_at=clock.loaded_at)


def scheduler_rows(
    sources: Mapping[str, Source], spark: SparkSession, drop_inactive: bool
) -> dict[str, DataFrame]:
    """The four scheduler extracts, projected; from views only active, current rows.

    Files keep inactive folders (flagged, not dropped). Filters and the
    projection come before rows are numbered and joined, so they reach the
    source.
    """

    def prepare(name: str) -> Callable[[DataFrame], DataFrame]:
        def narrowed(frame: DataFrame) -> DataFrame:
            rows = specs.project_view(frame, name)
            if not drop_inactive:
                return rows
            is_folder = name == "controlm_folders"
            return closure.active_folders(rows) if is_folder else specs.current_rows(rows)

        return narrowed

    rows = {
        name: sources[name].read(spark, prepare(name))
        for name in SCHEDULER_STAGES
        if name in sources
    }
    if drop_inactive:
        active = rows["controlm_folders"].select("folder_id")
        for name in SCHEDULER_STAGES[1:]:
            if name in rows:
                rows[name] = rows[name].join(active, "folder_id", "left_semi")
    return rows


def derived_dependencies(
    jobs: DataFrame, folders: DataFrame, links_in: DataFrame, links_out: DataFrame, **options
) -> DataFrame:
    """Dependency rows, the least per edge, from the four typed extracts.

    Options as in ``dependency_edges``. Only edges are stored, so no path is
    listed. The names at both ends are those of the path.
    """
    only_posting = options.pop("only_posting", False)
    consumes = closure.job_links(jobs, folders, links_in)
    produces = closure.job_links(jobs, folders, links_out, only_posting)
    edges = closure.dependency_edges(consumes, produces, **options)
    return edges.select(
        # Not stored, and may be empty.
        F.lit("").alias("in_parent_table"),
        F.lit("").alias("dependent_table"),
        F.substring_index("dependency_path", closure.ARROW, 1).alias("in_job_name"),
        F.substring_index("dependency_path", closure.ARROW, -1).alias("dependent_job"),
        closure.composite_key("in_parent_table_id", "in_job_id").alias("in_table_job_id"),
        closure.composite_key("dependent_table_id", "dependent_job_id").alias("out_table_job_id"),
        *edges.columns,
    )


def ingest_scheduler(
    tables: TableSet,
    sources: Mapping[str, Source],
    clock: RunClock | None = None,
    from_views: bool = False,
    structure_only: bool = False,
    dependencies: Source | None = None,
    **closure_options,
) -> dict[str, dict]:
    """Folders, jobs, conditions in and out, then derived dependencies.

    ``structure_only`` stops after the jobs. Dependencies are computed from
    the same extracts unless a source of ready rows is given.
    """
    clock = clock or RunClock()
    spark = tables.spark
    label = "oracle" if from_views else "csv"
    rows = scheduler_rows(sources, spark, drop_inactive=from_views)
    results: dict[str, dict] = {}
    for name in SCHEDULER_STAGES[:2] if structure_only else SCHEDULER_STAGES:
        results[name] = run_load(
            LOADS[name], rows[name], tables, _stage_clock(clock), label
        ).as_dict()
    if structure_only:
        return results
    if dependencies is not None:
        derived = dependencies.read(spark)
    else:
        raw = scheduler_rows(sources, spark, drop_inactive=False) if from_views else rows
        typed = {n: _typed(raw[n], n) for n in SCHEDULER_STAGES}
        edges = derived_dependencies(
            typed["controlm_jobs"],
            typed["controlm_folders"],
            typed["controlm_conditions_in"],
            typed["controlm_conditions_out"],
            **closure_options,
        )
        derived = with_sequence(edges)
    name = DEPENDENCIES.name
    results[name] = run_load(DEPENDENCIES, derived, tables, _stage_clock(clock), label).as_dict()
    return results


def _typed(rows: DataFrame, name: str) -> DataFrame:
    from jobweave.operators.validate import split_rows

    return split_rows(rows, specs.SPECS[name]).accepted


# Entity kind -> (snapshot table, key, node table, version edge table).
SNAPSHOTS = {
    "applications": ("application_snapshot", "seal_id", "application_has_version"),
    "products": ("product_snapshot", "product_id", "product_has_version"),
    "catalog_lobs": ("catalog_lob_snapshot", "lob_id", "catalog_lob_has_version"),
}


def entity_states(tables: TableSet) -> dict[str, DataFrame]:
    """Current state of the three versioned entity kinds whose tables exist."""
    optional = tables.read_or_none
    states: dict[str, DataFrame] = {}
    if tables.exists("application"):
        states["applications"] = history.application_state(
            tables.read("application"),
            tables.read("has_membership"),
            tables.read("held_by"),
            optional("product_has_application"),
            optional("application_has_dev_team"),
        )
    if tables.exists("product") and tables.exists("has_product"):
        states["products"] = history.product_state(
            tables.read("product"), tables.read("has_product"), optional("product_has_application")
        )
    if tables.exists("catalog_lob") and tables.exists("has_product_line"):
        states["catalog_lobs"] = history.lob_state(
            tables.read("catalog_lob"), tables.read("has_product_line"), tables.read("reconciles_to")
        )
    return states


def write_snapshots(tables: TableSet, clock: RunClock) -> dict[str, dict[str, int]]:
    """New versions of every entity whose state changed; counts per kind.

    An edge from each entity to its new version is written first, so that the
    version, by which a run knows its work is done, comes last.
    """
    counts: dict[str, dict[str, int]] = {}
    for kind, state in entity_states(tables).items():
        table, key, edge = SNAPSHOTS[kind]
        versions = VersionTable(tables, table)
        states = history.hashed_state(state, key)
        compared = stage(history.compare_states(states, versions.open_versions()), kind)
        counts[kind] = history.snapshot_counts(compared).first().asDict()
        new = history.new_versions(compared, clock)
        links = new.select(F.col("entity_key").alias(key), "snapshot_id")
        tables.add_to_run(edge, links, clock.run_id, ["snapshot_id"])
        versions.advance(compared, clock)
    return counts


def prune_snapshots(tables: TableSet, clock: RunClock, years: int = 5) -> dict[str, int]:
    """Delete versions past retention, keeping each entity's newest; counts per table."""
    deleted: dict[str, int] = {}
    for table, _, edge in SNAPSHOTS.values():
        if not tables.exists(table):
            continue
        deleted[table] = VersionTable(tables, table).prune(clock.run_date, years)
        if deleted[table]:
            kept = tables.read(table).select("snapshot_id")
            if tables.parts(edge):
                tables.write_parts(edge, tables.stored(edge).join(kept, "snapshot_id", "left_semi"))
            else:
                tables.write(edge, tables.read(edge).join(kept, "snapshot_id", "left_semi"))
    return deleted


def verify_reference(tables: TableSet) -> DataFrame:
    return quality.both_ports(
        tables.read("application"), tables.read("port"), "apps have both ports"
    )


def verify_scheduler(tables: TableSet) -> DataFrame:
    """Invariants of a loaded scheduler estate as (check, ok, detail)."""
    folders, jobs = tables.read("job_folder"), tables.read("controlm_job")
    checks = [
        quality.every_row_linked(
            folders, tables.read("runs_on"), ["folder_id"], "every folder has a server",
            ("folders", "srv_links"),
        ),
        quality.every_row_linked(
            jobs, tables.read("contains_job"), ["folder_id", "job_id"], "every job has a folder",
            ("jobs", "with_folder"),
        ),
        quality.no_duplicates(
            jobs, ["job_id", "version_serial"], "no duplicate (job_id, version_serial)"
        ),
        quality.no_duplicates(jobs, ["folder_id", "job_id"], "no duplicate (folder_id, job_id)"),
        quality.no_empty_parents(
            folders.filter("active"), tables.read("contains_job"), ["folder_id"],
            "active folders contain at least one job",
        ),
    ]
    if tables.exists("scheduler_kind"):
        kinds = tables.read("scheduler_kind").filter(F.col("name") == "ControlM")
        checks.append(quality.present_once(kinds, "ControlM scheduler kind seeded"))
    if tables.exists("ontology_term"):
        checks.append(quality.local_terms_seeded(tables.read("ontology_term")))
    if tables.exists("condition"):
        checks.append(
            quality.no_orphans(
                tables.read("condition"),
                [tables.read("requires_in_condition"), tables.read("emits_out_condition")],
                ["folder_id", "name"],
                "no orphan conditions",
            )
        )
    if tables.exists("was_informed_by"):
        checks.append(
            quality.edges_complete(
                tables.read("was_informed_by"), "derived edges have recursion_level + path"
            )
        )
    return quality.report(checks)


def verify_keys(tables: TableSet) -> DataFrame:
    """Every declared key whose table is present."""
    present = {
        table: tables.read(table)
        for table, columns in vocabulary.DECLARED_KEYS.values()
        if tables.exists(table)
    }
    if path_exists(tables.spark, RunLog(tables).path):
        present[RUN_TABLE] = RunLog(tables).runs()
    return quality.check_declared_keys(present, vocabulary.DECLARED_KEYS)


def term_counts(tables: TableSet) -> DataFrame:
    """Terms per vocabulary, by label."""
    labels = F.array(F.lit("OntologyTerm"), F.col("source_label"))
    return quality.label_counts(tables.read("ontology_term"), labels, skip=["OntologyTerm"]).orderBy(
        "source_label"
    )


# Node label -> table; runs are read from their log.
NODE_TABLES = {
    "JobFolder": "job_folder", "ControlMServer": "controlm_server", "ControlMJob": "controlm_job",
    "Condition": "condition", "Application": "application", "Port": "port",
    "Membership": "membership", "Role": "role", "Employee": "employee",
    "CatalogLOB": "catalog_lob", "BusinessSegment": "business_segment",
    "ProductLine": "product_line", "Product": "product", "DevTeam": "dev_team",
    "JiraBoard": "jira_board",
}
_FOLDER, _JOB = {"folder_id": "folder_id"}, {"folder_id": "folder_id", "job_id": "job_id"}
_BEFORE = {"predecessor_folder_id": "folder_id", "predecessor_job_id": "job_id"}
_CONDITION = {"folder_id": "folder_id", "name": "name"}
_APPLICATION, _MEMBER = {"seal_id": "seal_id"}, {"membership_id": "membership_id"}
_LOB, _LINE = {"lob_id": "lob_id"}, {"product_line_id": "product_line_id"}
_PRODUCT, _TEAM = {"product_id": "product_id"}, {"team_id": "team_id"}
_RUN = {"run_id": "run_id"}
# Edge table -> type and ends as the loads write them.
EDGE_TABLES = {
    table: quality.EdgeEnds(*ends)
    for table, *ends in (
        ("runs_on", "RUNS_ON", "JobFolder", _FOLDER, "ControlMServer", {"server": "name"}),
        ("contains_job", "CONTAINS_JOB", "JobFolder", _FOLDER, "ControlMJob", _JOB),
        ("requires_in_condition", "REQUIRES_IN_CONDITION", "ControlMJob", _JOB, "Condition", _CONDITION),
        ("emits_out_condition", "EMITS_OUT_CONDITION", "ControlMJob", _JOB, "Condition", _CONDITION),
        ("was_informed_by", "WAS_INFORMED_BY", "ControlMJob", _JOB, "ControlMJob", _BEFORE),
        ("has_port", "HAS_PORT", "Application", _APPLICATION, "Port",
         {"seal_id": "parent_seal_id", "kind": "kind"}),
        ("has_membership", "HAS_MEMBERSHIP", "Application", _APPLICATION, "Membership", _MEMBER),
        ("of_role", "OF_ROLE", "Membership", _MEMBER, "Role", {"role_name": "name"}),
        ("held_by", "HELD_BY", "Membership", _MEMBER, "Employee", {"employee_id": "employee_id"}),
        ("reconciles_to", "RECONCILES_TO", "CatalogLOB", _LOB, "BusinessSegment", {"segment_code": "code"}),
        ("has_product_line", "HAS_PRODUCT_LINE", "CatalogLOB", _LOB, "ProductLine", _LINE),
        ("has_product", "HAS_PRODUCT", "ProductLine", _LINE, "Product", _PRODUCT),
        ("has_dev_team", "HAS_DEV_TEAM", "Product", _PRODUCT, "DevTeam", _TEAM),
        ("has_jira_board", "HAS_JIRA_BOARD", "DevTeam", _TEAM, "JiraBoard", {"board_id": "board_id"}),
        ("job_folder_was_generated_by", "WAS_GENERATED_BY", "JobFolder", _FOLDER, "JobRun", _RUN),
        ("controlm_job_was_generated_by", "WAS_GENERATED_BY", "ControlMJob", _JOB, "JobRun", _RUN),
        ("condition_was_generated_by", "WAS_GENERATED_BY", "Condition", _CONDITION, "JobRun", _RUN),
        ("application_was_generated_by", "WAS_GENERATED_BY", "Application", _APPLICATION, "JobRun", _RUN),
        ("membership_was_generated_by", "WAS_GENERATED_BY", "Membership", _MEMBER, "JobRun", _RUN),
    )
}


def edge_findings(tables: TableSet) -> DataFrame:
    """What loaded edges break: ends without a node, undeclared ends, ends of the wrong kind.

    Ends are looked up in the node tables; a node table that is missing has no node.
    """
    spark = tables.spark

    def nodes(label: str, keys: Mapping[str, str]) -> DataFrame:
        if label == "JobRun":
            return RunLog(tables).runs()
        rows = tables.read_or_none(NODE_TABLES[label])
        if rows is None:
            schema = ", ".join(f"{k} string" for k in keys.values())
            return literal_table(spark, [], schema)
        return rows

    censuses = [
        quality.edge_census(
            tables.read(table), ends, nodes(ends.from_node, ends.from_on), nodes(ends.to_node, ends.to_on)
        )
        for table, ends in EDGE_TABLES.items()
        if tables.exists(table)
    ]
    schema = "edge_type string, from_node string, to_node string, edges bigint"
    census = reduce(DataFrame.unionByName, censuses, literal_table(spark, [], schema))
    return quality.edge_findings(
        stage(census, "edge-census"),
        vocabulary.edge_registry(spark),
        vocabulary.provenance_matrix(spark),
        vocabulary.node_kinds(spark),
    )


def verify_registry(tables: TableSet) -> DataFrame:
    """Loaded edges against the node tables, the declared edges and the kinds; unique registry ids."""
    findings = edge_findings(tables)
    return quality.report(
        [
            quality.no_findings(findings, "undeclared", "edges are declared"),
            quality.no_findings(findings, "stray", "edges end at nodes"),
            quality.no_findings(findings, "off_matrix", "edges link the kinds their term allows"),
            quality.no_duplicates(vocabulary.edge_registry(tables.spark), ["id"], "registry ids are unique"),
        ]
    )
