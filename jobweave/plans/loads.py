"""What each source writes: declared merges into node and edge tables.

A load checks its rows in one scan, keeps rows whose parents exist, and merges
each declared table with one shuffle per table. Adding a source means adding a
:class:`Load`; no code in the runner changes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.reshape import splay_list, wide_to_long
from jobweave.operators.upsert import Merge, fixed_children, is_given, require_parents
from jobweave.operators.validate import RowSpec, split_rows_once
from jobweave.session import RunClock
from jobweave.sinks.runs import LoadSummary, RunLog
from jobweave.sinks.tables import TableSet
from jobweave.sinks.together import run_together
from jobweave.sources import specs
from jobweave.sources.files import StagedFolder
from jobweave.sources.readers import SEQ

Columns = Mapping[str, str]

# Audit columns every batch carries: names on the right are added by the runner.
SEEN = {"last_seen_at": "_loaded_at", "last_run_id": "_run_id"}
EDGE_SEEN = {"last_seen_at": "_loaded_at"}


def _source_column(source: str) -> Column:
    """A batch column by name, or ``=text`` for a constant."""
    if source.startswith("="):
        return F.lit(source[1:])
    return F.col(source)


@dataclass(frozen=True)
class Write:
    """One merged table: target columns from batch columns or ``=text`` constants.

    ``parents`` lists (table, {batch column: key column}) that must exist for
    this write only. ``rows`` reshapes the batch first; ``where`` filters it.
    """

    table: str
    keys: Columns
    create_only: Columns = field(default_factory=dict)
    set_columns: Columns = field(default_factory=dict)
    keep_old: Columns = field(default_factory=dict)
    parents: tuple[tuple[str, Mapping[str, str]], ...] = ()
    rows: Callable[[DataFrame], DataFrame] | None = None
    where: Callable[[], Column] | None = None

    def merge(self) -> Merge:
        return Merge(
            tuple(self.keys), tuple(self.create_only), tuple(self.set_columns), tuple(self.keep_old)
        )

    def match(self, good: DataFrame, tables: TableSet) -> tuple[DataFrame, list[DataFrame]]:
        """The rows that have this write's own parents; and, per parent, those lost for want of it."""
        rows = self.rows(good) if self.rows else good
        if self.where is not None:
            rows = rows.filter(self.where())
        lost = []
        for table, on in self.parents:
            rows, without = require_parents(rows, tables.read(table), on)
            lost.append(without)
        return rows, lost

    def batch(self, good: DataFrame, tables: TableSet) -> DataFrame:
        rows, _ = self.match(good, tables)
        chosen = {**self.keys, **self.create_only, **self.set_columns, **self.keep_old}
        return rows.select(SEQ, *[_source_column(c).alias(name) for name, c in chosen.items()])


@dataclass(frozen=True)
class Load:
    """A source: its row spec, the parents every row needs, and its writes."""

    spec: RowSpec
    writes: tuple[Write, ...]
    parents: tuple[tuple[str, Mapping[str, str]], ...] = ()
    source_label: str = "csv"
    version: str = "v1"

    @property
    def name(self) -> str:
        return self.spec.name

    @property
    def loader(self) -> str:
        return f"{self.spec.name}.{self.version}"


def _apply(write: Write, rows: DataFrame, tables: TableSet) -> None:
    batch = write.batch(rows, tables)
    tables.merge(write.table, batch, write.merge())


def _lost_rows(load: Load, clock: RunClock, lost: DataFrame, table: str | None = None) -> DataFrame:
    """Unmatched rows as they are kept: ``table`` is NULL where no table took the row."""
    names = [n for n in load.spec.names if n in lost.columns]
    return lost.select(
        F.lit(clock.run_id).alias("run_id"),
        F.lit(load.loader).alias("loader"),
        F.col(SEQ).cast("string").alias("row_index"),
        F.to_json(F.struct(*names)).alias("row"),
        F.lit(table).cast("string").alias("table"),
    )


def run_load(
    load: Load, source: DataFrame, tables: TableSet, clock: RunClock, source_label: str | None = None
) -> LoadSummary:
    """Check, match, merge and log one source; rejected and unmatched rows are kept.

    The writes of one load touch different tables, so they run together. A row
    may lack a parent of one write only (an edge): the others take it, and it is
    kept as unmatched under that table's name. A bad row never fails the run.
    Any other error marks the run FAILED and is raised again.
    """
    log = RunLog(tables)
    label = source_label or load.source_label
    summary = log.open(clock, load.loader, label)
    try:
        checked = split_rows_once(source, load.spec)
        summary.rows_processed = checked.accepted_count
        summary.rows_rejected = checked.rejected_count
        if summary.rows_rejected:
            tables.replace_run(
                "rejected_row",
                checked.rejected.select(
                    F.lit(clock.run_id).alias("run_id"),
                    F.lit(load.loader).alias("loader"),
                    F.col(SEQ).cast("string").alias("row_index"),
                    F.col("_errors").alias("errors"),
                    F.to_json("_raw").alias("raw"),
                ),
                clock.run_id,
                load.loader,
            )
        good = checked.accepted.withColumns(
            {
                "_loaded_at": clock.timestamp(),
                "_run_id": F.lit(clock.run_id),
                "_loader": F.lit(load.loader),
                "_run_date": clock.day(),
            }
        )
        matched, lost = good, []
        folder = StagedFolder(tables.spark, f"matched-{load.name}")
        for table, on in load.parents:
            # A row is lost at the first parent it lacks, whatever it ties with.
            matched, without = require_parents(matched, tables.read(table), on)
            lost.append(_lost_rows(load, clock, without))
        if load.parents:
            matched, found = folder.write(matched, "rows")
            summary.rows_unmatched = summary.rows_processed - found
        edges = [
            _lost_rows(load, clock, without, write.table)
            for write in load.writes
            for without in write.match(matched, tables)[1]
        ]
        if edges:
            kept, summary.edges_unmatched = folder.write(reduce(DataFrame.unionByName, edges), "edges")
            lost.append(kept)
        if summary.rows_unmatched or summary.edges_unmatched:
            tables.replace_run(
                "unmatched_row", reduce(DataFrame.unionByName, lost), clock.run_id, load.loader
            )
        run_together(
            tables.spark, [partial(_apply, write, matched, tables) for write in load.writes]
        )
    except Exception:
        log.close(summary, "FAILED")
        raise
    return log.close(summary, "OK")


def _created(source: str) -> dict[str, str]:
    return {"created_at": "_loaded_at", "source": f"={source}"}


def _first_seen(source: str) -> dict[str, str]:
    return {"first_seen_at": "_loaded_at", "source": f"={source}", "loader": "_loader"}


def _same(*names: str) -> dict[str, str]:
    return {name: name for name in names}


def _given(column: str) -> Callable[[], Column]:
    return partial(is_given, column)


def _generated(table: str, keys: Columns, source: str) -> Write:
    """Provenance edges from a loaded row to this run."""
    return Write(
        f"{table}_was_generated_by",
        {**keys, "run_id": "_run_id", "source": f"={source}"},
        create_only={"first_seen_at": "_loaded_at"},
        set_columns={"last_seen_at": "_loaded_at"},
    )


# --- catalog -----------------------------------------------------------------

LOBS = Load(
    specs.LOBS,
    (
        Write("catalog_lob", _same("lob_id"), _created("catalog"), {**_same("code", "name"), **SEEN}),
        Write(
            "business_segment", {"code": "reconciles_to_segment"},
            where=_given("reconciles_to_segment"),
        ),
        Write(
            "reconciles_to",
            {"lob_id": "lob_id", "segment_code": "reconciles_to_segment"},
            _first_seen("catalog"),
            {"confidence": "reconcile_confidence", **SEEN},
            where=_given("reconciles_to_segment"),
        ),
    ),
)

PRODUCT_LINES = Load(
    specs.PRODUCT_LINES,
    (
        Write("product_line", _same("product_line_id"), _created("catalog"), {**_same("name"), **SEEN}),
        Write(
            "has_product_line",
            {"lob_id": "parent_lob_id", "product_line_id": "product_line_id"},
            _first_seen("catalog"),
            SEEN,
            parents=(("catalog_lob", {"parent_lob_id": "lob_id"}),),
        ),
    ),
)


def _not_orphan(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_orphan", F.lit(False))


PRODUCTS = Load(
    specs.PRODUCTS,
    (
        Write(
            "product",
            _same("product_id"),
            {**_created("catalog"), "orphan": "_orphan"},
            {**_same("name"), **SEEN},
            rows=_not_orphan,
        ),
        Write(
            "has_product",
            {"product_line_id": "parent_product_line_id", "product_id": "product_id"},
            _first_seen("catalog"),
            SEEN,
            parents=(("product_line", {"parent_product_line_id": "product_line_id"}),),
        ),
    ),
)

DEV_TEAMS = Load(
    specs.DEV_TEAMS,
    (
        Write("dev_team", _same("team_id"), _created("catalog"), {**_same("name"), **SEEN}),
        Write(
            "jira_board",
            {"board_id": "jira_board_id"},
            {"created_at": "_loaded_at"},
            where=_given("jira_board_id"),
        ),
        Write(
            "has_jira_board",
            {"team_id": "team_id", "board_id": "jira_board_id"},
            where=_given("jira_board_id"),
        ),
        Write("product", {"product_id": "parent_product_id"}, where=_given("parent_product_id")),
        Write(
            "has_dev_team",
            {"product_id": "parent_product_id", "team_id": "team_id"},
            _first_seen("catalog"),
            SEEN,
            where=_given("parent_product_id"),
        ),
    ),
)

# --- applications and contacts -------------------------------------------------

# Application columns kept under their own name, and those renamed.
_APPLICATION_SAME = (
    "name", "app_short_name", "description", "investment_strategy", "creation_date",
    "actual_build_start_date", "actual_operate_date", "actual_decom_date",
    "actual_retirement_date", "planned_build_start_date", "planned_operate_date",
    "planned_decom_date", "planned_decom_date_chg_reason", "planned_retirement_date",
    "replaced_by_app_ids", "replacement_app_type", "retirement_type", "app_lob",
    "reporting_cio_lob", "reporting_cto_group", "tech_group_owner", "tech_group_owner_id",
    "owning_legal_entity", "using_lob_sub_lobs", "sox_reportable", "glba_reportable",
    "pci_reportable", "soc1_reportable", "ccar_reportable", "global_statutory_audit",
    "payment_card_industry_category", "info_classification", "personal_info",
    "sensitive_personal_info", "client_confidential_info", "phi", "mnpi", "strictest_rpo",
    "strictest_rto", "hosting_vendor", "overall_hosting_type", "platforms", "kapp",
    "provides_platforms", "programming_languages", "app_dev_responsibility",
    "app_dev_vendor_name", "firm_owned_source_code", "authentication_type", "authorization_type",
    "fine_grain_authorization_type", "external_network_connectivity", "external_network_exposure",
    "tier_0_1_or_2_network_assets", "external_api_connectivity", "external_access_control",
    "certification_status", "last_certified_by_sid", "last_certified_date", "data_integrity",
    "capture_date",
)
_APPLICATION_RENAMED = {
    "status": "app_state",
    "risk_level": "overall_risk_rating",
    "sox_governed": "sox_reportable",
}
PORT_KINDS = ("EventProcessing", "BatchProcessing")
# Contacts embedded in an application row, by role.
EMBEDDED_CONTACTS = {
    "Application Owner": ("app_owner_sid", "app_owner_name"),
    "CTO": ("chief_tech_officer_sid", "chief_tech_officer_name"),
    "Primary Information Owner": ("info_owner_sid", "info_owner_name"),
}


def _ports(rows: DataFrame) -> DataFrame:
    return fixed_children(rows, PORT_KINDS).withColumn("_inactive", F.lit(False))


def _membership_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "membership_id": F.concat_ws(
                "|", "app_id", F.lit("SEAL"), "role_name", "employee_sid"
            ),
            "_open_end": F.lit(None).cast("date"),
        }
    )


def embedded_contacts(rows: DataFrame) -> DataFrame:
    """Wide contact pairs of an application row as one row per contact that has an id.

    The position inside the row extends the input order, so a person named
    twice keeps the later name.
    """
    kept = [SEQ, "app_id", "_loaded_at", "_run_id", "_loader", "_run_date"]
    names = ["employee_sid", "employee_name"]
    long = wide_to_long(rows, kept, EMBEDDED_CONTACTS, names, "role_name")
    ordered = F.struct(F.col(SEQ).alias("row"), F.col("_position").alias("position"))
    return _membership_columns(long.withColumn(SEQ, ordered).drop("_position"))


_MEMBERSHIP = dict(
    keys=_same("membership_id"),
    create_only={
        "source": "=SEAL",
        "valid_from": "_run_date",
        "valid_to": "_open_end",
        "created_at": "_loaded_at",
    },
    set_columns=SEEN,
)
_HAS_MEMBERSHIP = {"seal_id": "app_id", "membership_id": "membership_id"}

APPLICATIONS = Load(
    specs.APPLICATIONS,
    (
        Write(
            "application",
            {"seal_id": "app_id"},
            _created("SEAL"),
            {**_same(*_APPLICATION_SAME), **_APPLICATION_RENAMED, **SEEN},
        ),
        Write(
            "port",
            {"parent_seal_id": "app_id", "kind": "kind"},
            {"created_at": "_loaded_at", "active": "_inactive"},
            EDGE_SEEN,
            rows=_ports,
        ),
        Write("has_port", {"seal_id": "app_id", "kind": "kind"}, rows=_ports),
        _generated("application", {"seal_id": "app_id"}, "SEAL"),
        Write(
            "employee",
            {"employee_id": "employee_sid"},
            _created("SEAL"),
            SEEN,
            {"full_name": "employee_name"},
            rows=embedded_contacts,
        ),
        Write("role", {"name": "role_name"}, rows=embedded_contacts),
        Write("membership", **_MEMBERSHIP, rows=embedded_contacts),
        Write("has_membership", _HAS_MEMBERSHIP, rows=embedded_contacts),
        Write(
            "of_role",
            {"membership_id": "membership_id", "role_name": "role_name"},
            rows=embedded_contacts,
        ),
        Write(
            "held_by",
            {"membership_id": "membership_id", "employee_id": "employee_sid"},
            rows=embedded_contacts,
        ),
    ),
)

_EDGE_AUDIT = dict(
    create_only={"first_seen_at": "_loaded_at", "source": "=SEAL"}, set_columns=EDGE_SEEN
)
CONTACTS = Load(
    specs.CONTACTS,
    (
        Write(
            "employee",
            {"employee_id": "employee_sid"},
            _created("SEAL"),
            SEEN,
            {"full_name": "employee_name", "email": "employee_email"},
        ),
        Write("membership", **_MEMBERSHIP, rows=_membership_columns),
        Write("has_membership", _HAS_MEMBERSHIP, rows=_membership_columns),
        Write(
            "of_role",
            {"membership_id": "membership_id", "role_name": "role_name"},
            **_EDGE_AUDIT,
            rows=_membership_columns,
        ),
        Write(
            "held_by",
            {"membership_id": "membership_id", "employee_id": "employee_sid"},
            **_EDGE_AUDIT,
            rows=_membership_columns,
        ),
        Write(
            "membership_was_generated_by",
            {"membership_id": "membership_id", "run_id": "_run_id", "source": "=SEAL"},
            create_only={"first_seen_at": "_loaded_at"},
            set_columns=EDGE_SEEN,
            rows=_membership_columns,
        ),
    ),
    parents=(("application", {"app_id": "seal_id"}), ("role", {"role_name": "name"})),
)

# --- scheduler ---------------------------------------------------------------

# The source recorded on rows of each scheduler extract.
_FOLDER_VIEW, _JOB_VIEW = "scheduler.folders", "scheduler.jobs"
_IN_VIEW, _OUT_VIEW = "scheduler.conditions_in", "scheduler.conditions_out"
_DERIVED = "scheduler.derived"

FOLDERS = Load(
    specs.FOLDERS,
    (
        Write("controlm_server", {"name": "data_center"}, _created(_FOLDER_VIEW), SEEN),
        Write(
            "job_folder",
            _same("folder_id"),
            _created(_FOLDER_VIEW),
            {
                **_same(
                    "sched_table", "user_daily", "table_status", "table_type", "instance_name",
                    "last_updated", "last_updated_user", "capture_date", "environment_code",
                    "environment", "lob_code", "lob", "app_code", "folder_type_code", "folder_type",
                    "prefix_recognized", "active",
                ),
                **SEEN,
            },
        ),
        Write(
            "runs_on",
            {"folder_id": "folder_id", "server": "data_center"},
            {"since": "_loaded_at", "source": f"={_FOLDER_VIEW}", "loader": "_loader"},
            SEEN,
        ),
        _generated("job_folder", _same("folder_id"), "BMC"),
    ),
    source_label="oracle",
)

JOBS = Load(
    specs.JOBS,
    (
        Write(
            "controlm_job",
            _same("folder_id", "job_id"),
            _created(_JOB_VIEW),
            {
                **_same(*[n for n in specs.JOBS.names if n not in ("folder_id", "job_id")], "active"),
                **SEEN,
            },
        ),
        Write("contains_job", _same("folder_id", "job_id"), _first_seen(_JOB_VIEW), SEEN),
        _generated("controlm_job", _same("folder_id", "job_id"), "BMC"),
    ),
    parents=(("job_folder", _same("folder_id")),),
    source_label="oracle",
)


def _condition_writes(view: str, edge: str, properties: tuple[str, ...]) -> tuple[Write, ...]:
    key = {"folder_id": "folder_id", "name": "condition_name"}
    return (
        Write(
            "condition",
            key,
            _created(view),
            {"version_serial": "version_serial", "last_capture_date": "capture_date", **SEEN},
        ),
        Write(
            edge,
            {"folder_id": "folder_id", "job_id": "job_id", "name": "condition_name"},
            _first_seen(view),
            {**_same(*properties), **SEEN},
        ),
        _generated("condition", key, "BMC"),
    )


_JOB_PARENT = (("controlm_job", _same("folder_id", "job_id")),)
CONDITIONS_IN = Load(
    specs.CONDITIONS_IN,
    _condition_writes(
        _IN_VIEW,
        "requires_in_condition",
        ("odate", "and_or", "parentheses", "order_", "isn", "version_opcode"),
    ),
    parents=_JOB_PARENT,
    source_label="oracle",
)
CONDITIONS_OUT = Load(
    specs.CONDITIONS_OUT,
    _condition_writes(
        _OUT_VIEW, "emits_out_condition", ("odate", "sign", "isn", "version_opcode")
    ),
    parents=_JOB_PARENT,
    source_label="oracle",
)


def _shortest_first(rows: DataFrame) -> DataFrame:
    """First-wins by (level, path), whatever order the rows arrive in."""
    return rows.withColumns(
        {SEQ: F.struct("recursion_level", "dependency_path"), "_derived": F.lit(True)}
    )


DEPENDENCIES = Load(
    specs.DEPENDENCIES,
    (
        Write(
            "was_informed_by",
            {
                "folder_id": "in_parent_table_id",
                "job_id": "in_job_id",
                "predecessor_folder_id": "dependent_table_id",
                "predecessor_job_id": "dependent_job_id",
                "via_condition": "out_condition",
            },
            {
                "derived": "_derived",
                **_same("recursion_level", "dependency_path"),
                **_first_seen(_DERIVED),
            },
            SEEN,
            rows=_shortest_first,
        ),
    ),
    parents=(
        ("controlm_job", {"in_parent_table_id": "folder_id", "in_job_id": "job_id"}),
        ("controlm_job", {"dependent_table_id": "folder_id", "dependent_job_id": "job_id"}),
    ),
    source_label="oracle",
)

# --- optional: which team develops which application ----------------------------


def _mapped_applications(rows: DataFrame) -> DataFrame:
    return splay_list(rows, "seal_ids", "seal_id").withColumn("_orphan", F.lit(True))


# An application nobody has loaded yet becomes a stub flagged as orphan.
PRODUCT_MAPPING = Load(
    specs.PRODUCT_MAPPING,
    (
        Write("dev_team", _same("team_id"), _created("PAT"), SEEN, {"name": "team_name"}),
        Write("application", _same("seal_id"), {"orphan": "_orphan"}, rows=_mapped_applications),
        Write(
            "application_has_dev_team",
            _same("seal_id", "team_id"),
            _first_seen("PAT"),
            SEEN,
            rows=_mapped_applications,
        ),
        Write(
            "product_has_application",
            _same("product_id", "seal_id"),
            _first_seen("PAT"),
            SEEN,
            rows=_mapped_applications,
            where=_given("product_id"),
        ),
    ),
)

# Loads by name.
LOADS = {
    load.name: load
    for load in (
        APPLICATIONS, CONTACTS, LOBS, PRODUCT_LINES, PRODUCTS, DEV_TEAMS, FOLDERS, JOBS,
        CONDITIONS_IN, CONDITIONS_OUT, DEPENDENCIES,
    )
}
