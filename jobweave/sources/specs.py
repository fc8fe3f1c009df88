"""Row specs of the twelve source extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.names import with_folder_name
from jobweave.operators.validate import Field, RowSpec


def _required(*names: str) -> list[Field]:
    return [Field(n, required=True) for n in names]


def _optional(*names: str, nulls: str = "blank") -> list[Field]:
    return [Field(n, nulls=nulls) for n in names]


def _integers(*names: str) -> list[Field]:
    return [Field(n, "integer") for n in names]


_VERSION = Field("version_serial", "integer", required=True, low=0)
_NAME_COLUMNS = (
    "environment_code", "environment", "lob_code", "lob", "app_code", "folder_type_code",
    "folder_type", "prefix_recognized",
)


def _folder_columns(df: DataFrame) -> DataFrame:
    scheduled = F.coalesce(F.col("user_daily") != "", F.lit(False))
    return with_folder_name(df, "sched_table", _NAME_COLUMNS).withColumn("active", scheduled)


def _job_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("active", F.col("is_current_version") == "1")


FOLDERS = RowSpec(
    "controlm_folders",
    (
        *_required("folder_id", "sched_table", "data_center"),
        *_optional("user_daily", "table_status"),
        *_integers("table_type"),
        *_optional("instance_name", "last_updated", "last_updated_user", "capture_date"),
    ),
    _folder_columns,
)

JOBS = RowSpec(
    "controlm_jobs",
    (
        *_required("job_id"),
        _VERSION,
        *_required("folder_id", "job_name"),
        *_optional("parent_table", "application", "group_name", "task_type", "cyclic", "cyclic_type"),
        *_integers("job_order"),
        *_optional(
            "owner", "author", "node_id", "cmd_line", "description", "memname", "priority",
            "critical", "active_from", "active_till", "end_folder", "is_current_version",
            "version_opcode", "version_timestamp", "version_user", "instance_name", "capture_date",
        ),
    ),
    _job_columns,
)

CONDITIONS_IN = RowSpec(
    "controlm_conditions_in",
    (
        *_required("folder_id", "job_id"),
        _VERSION,
        *_required("condition_name"),
        *_optional("odate", "and_or", "parentheses"),
        *_integers("order_", "isn"),
        *_optional("version_opcode", "is_current_version", "capture_date"),
    ),
)

CONDITIONS_OUT = RowSpec(
    "controlm_conditions_out",
    (
        *_required("folder_id", "job_id"),
        _VERSION,
        *_required("condition_name"),
        *_optional("odate", "sign"),
        *_integers("isn"),
        *_optional("version_opcode", "is_current_version", "capture_date"),
    ),
)

_MAY_BE_EMPTY = [
    Field(n, required=True, nonempty=False)
    for n in (
        "in_parent_table", "in_parent_table_id", "in_job_id", "in_table_job_id", "out_condition",
        "dependent_table", "dependent_table_id", "dependent_job_id", "out_table_job_id",
        "dependency_path",
    )
]
DEPENDENCIES = RowSpec(
    "controlm_dependencies_derived",
    (
        *_MAY_BE_EMPTY,
        *_required("in_job_name", "dependent_job"),
        Field("recursion_level", "integer", required=True, low=1),
    ),
)

# Column order of the application extract; flags are yes / no cells.
_APPLICATION_TEXT = (
    "app_short_name", "description", "app_state", "investment_strategy", "creation_date",
    "actual_build_start_date", "actual_operate_date", "actual_decom_date",
    "actual_retirement_date", "planned_build_start_date", "planned_operate_date",
    "planned_decom_date", "planned_decom_date_chg_reason", "planned_retirement_date",
    "replaced_by_app_ids", "replacement_app_type", "retirement_type", "app_lob",
    "reporting_cio_lob", "reporting_cto_group", "tech_group_owner", "tech_group_owner_id",
    "owning_legal_entity", "using_lob_sub_lobs", "overall_risk_rating",
    "payment_card_industry_category", "info_classification", "strictest_rpo", "strictest_rto",
    "hosting_vendor", "overall_hosting_type", "platforms", "kapp", "provides_platforms",
    "programming_languages", "app_dev_responsibility", "app_dev_vendor_name",
    "source_code_vendor_name", "direct_access_vendor_name", "authentication_type",
    "authorization_type", "fine_grain_authorization_type", "not_external_facing_reason",
    "app_owner_sid", "app_owner_name", "chief_tech_officer_sid", "chief_tech_officer_name",
    "info_owner_sid", "info_owner_name", "capture_date", "certification_status",
    "last_certified_by_sid", "last_certified_date", "data_integrity", "externally_mandated_type",
)
_APPLICATION_FLAGS = (
    "sox_reportable", "glba_reportable", "pci_reportable", "soc1_reportable", "ccar_reportable",
    "global_statutory_audit", "personal_info", "sensitive_personal_info",
    "client_confidential_info", "phi", "mnpi", "firm_owned_source_code", "internally_shared",
    "dev_app_only", "external_service", "tech_maintained", "hardware_deployments",
    "software_deployments", "third_party_direct_access", "vendor_engagements",
    "cpof_logical_deployment", "hvbe", "iwp_deployment", "external_network_connectivity",
    "external_network_exposure", "tier_0_1_or_2_network_assets", "external_api_connectivity",
    "external_access_control", "instant_change_authorization", "externally_mandated",
)
APPLICATIONS = RowSpec(
    "seal_applications",
    (
        Field("app_id", required=True, nulls="tokens"),
        Field("name", required=True, nulls="tokens"),
        *_optional(*_APPLICATION_TEXT, nulls="tokens"),
        *[Field(n, "flag") for n in _APPLICATION_FLAGS],
    ),
)

CONTACTS = RowSpec(
    "seal_contacts",
    (
        Field("app_id", required=True, nulls="tokens"),
        Field("role_name", "role"),
        Field("employee_sid", required=True, nulls="tokens"),
        *_optional("employee_name", "employee_email", nulls="tokens"),
    ),
)

SEGMENTS = RowSpec(
    "business_segments",
    (
        *_required("code", "name"),
        Field("effective_from", "day"),
        Field("effective_to", "day"),
        Field("retired", "strict_flag", default=False),
    ),
)

LOBS = RowSpec(
    "catalog_lobs",
    (
        *_required("lob_id"),
        *_optional("code", "name", "reconciles_to_segment", nulls="keep"),
        Field("reconcile_confidence", "number", low=0.0, high=1.0),
    ),
)

PRODUCT_LINES = RowSpec(
    "product_lines", tuple(_required("product_line_id", "name", "parent_lob_id"))
)

PRODUCTS = RowSpec("products", tuple(_required("product_id", "name", "parent_product_line_id")))

DEV_TEAMS = RowSpec(
    "dev_teams",
    (
        *_required("team_id", "name"),
        *_optional("jira_board_id", "parent_product_id", nulls="keep"),
    ),
)

# One row per team; the applications it develops are one comma-separated cell.
PRODUCT_MAPPING = RowSpec(
    "product_mapping",
    (*_required("team_id"), *_optional("team_name", "product_id", "seal_ids")),
)

# Source columns of the scheduler extracts when they come from database views.
VIEW_COLUMNS = {
    "controlm_folders": {"table_id": "folder_id"},
    "controlm_jobs": {"table_id": "folder_id"},
    "controlm_conditions_in": {
        "table_id": "folder_id", "condition": "condition_name", "isn_": "isn",
    },
    "controlm_conditions_out": {
        "table_id": "folder_id", "condition": "condition_name", "isn_": "isn",
    },
}
SPECS = {
    s.name: s
    for s in (
        LOBS, PRODUCT_LINES, PRODUCTS, DEV_TEAMS, APPLICATIONS, CONTACTS, FOLDERS, JOBS,
        CONDITIONS_IN, CONDITIONS_OUT, DEPENDENCIES, SEGMENTS,
    )
}


def project_view(df: DataFrame, name: str) -> DataFrame:
    """Rename view columns and keep only those the spec reads, before any join."""
    names = VIEW_COLUMNS.get(name, {})
    renamed = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    wanted = [c for c in SPECS[name].names if c in renamed.columns]
    order = [c for c in ("_seq",) if c in renamed.columns]
    return renamed.select(*wanted, *order)


def current_rows(df: DataFrame) -> DataFrame:
    """Rows of the current version; the flag is text."""
    return df.filter(F.col("is_current_version") == "1")
