"""Static vocabularies: terms, roles, segments, quality catalog, edge registry.

All are a few dozen fixed rows kept as local relations, so their size is known
and never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.identifiers import LOCAL_NAMESPACE, NAMESPACES
from jobweave.sources.readers import literal_table

# Anchor terms by vocabulary, as (label of the set, namespace
# prefix, {local name: label}).
TERM_SETS = [
    ("DprodClass", "dprod", {
        "DataProduct": "Data Product",
        "Port": "Port",
        "InputPort": "Input Port",
        "OutputPort": "Output Port",
        "DataContract": "Data Contract",
        "Agreement": "Agreement",
    }),
    ("DprodProperty", "dprod", {
        "hasInputPort": "has input port",
        "hasOutputPort": "has output port",
        "exposesDataset": "exposes dataset",
    }),
    ("DcatClass", "dcat", {
        "Catalog": "Catalog",
        "Dataset": "Dataset",
        "Distribution": "Distribution",
        "DataService": "Data Service",
        "DataProduct": "DCAT Data Product (v3)",
    }),
    ("DcatProperty", "dcat", {
        "theme": "theme",
        "contactPoint": "contact point",
        "distribution": "distribution",
        "accessURL": "access URL",
        "downloadURL": "download URL",
        "mediaType": "media type",
        "keyword": "keyword",
        "endpointURL": "endpoint URL",
    }),
    ("ProvClass", "prov", {
        "Entity": "Entity",
        "Activity": "Activity",
        "Agent": "Agent",
        "Plan": "Plan",
        "Collection": "Collection",
        "SoftwareAgent": "Software Agent",
    }),
    ("ProvProperty", "prov", {
        "used": "used",
        "wasGeneratedBy": "was generated by",
        "generated": "generated",
        "hadMember": "had member",
        "wasAttributedTo": "was attributed to",
        "wasAssociatedWith": "was associated with",
        "wasInformedBy": "was informed by",
        "wasDerivedFrom": "was derived from",
        "actedOnBehalfOf": "acted on behalf of",
    }),
    ("DqvClass", "dqv", {
        "QualityMeasurement": "Quality Measurement",
        "Metric": "Metric",
        "Dimension": "Dimension",
        "Category": "Category",
        "QualityAnnotation": "Quality Annotation",
    }),
    ("DqvProperty", "dqv", {
        "hasQualityMeasurement": "has quality measurement",
        "computedOn": "computed on",
        "isMeasurementOf": "is measurement of",
        "inDimension": "in dimension",
        "value": "value",
    }),
    ("OrgClass", "org", {
        "Organization": "Organization",
        "OrganizationalUnit": "Organizational Unit",
        "FormalOrganization": "Formal Organization",
        "Membership": "Membership",
        "Role": "Role",
    }),
    ("OrgProperty", "org", {
        "hasUnit": "has unit",
        "hasMember": "has member",
        "memberOf": "member of",
        "role": "role",
        "hasMembership": "has membership",
    }),
    ("SwoClass", "swo", {
        "SWO_0000001": "software",
        "SWO_0000118": "Python",
        "SWO_0000124": "Shell",
        "SWO_0000012": "Java",
        "SWO_0000126": "SQL",
    }),
    ("SwoClass", "iao", {"IAO_0000025": "programming language"}),
    ("SwoClass", "obi", {"OBI_0200000": "data transformation"}),
    ("SwoProperty", "swo", {
        "SWO_0040005": "is executed in",
        "SWO_0000741": "is encoded in",
        "SWO_0000740": "implements",
        "SWO_0000086": "has specified data input",
        "SWO_0000087": "has specified data output",
        "SWO_0000150": "uses platform",
    }),
    ("OlClass", "ol", {"Run": "OL Run", "Job": "OL Job", "Dataset": "OL Dataset"}),
]

# Local concepts per supplement, their label, and the published
# class each is a kind of (None: no counterpart).
LOCAL_CLASSES = {
    "scheduler": {
        "ControlMServer": ("Control-M Server", None),
        "JobFolder": ("Control-M Job Folder", "prov:Collection"),
        "ControlMJob": ("Control-M Job", "prov:Activity"),
    },
    "applications": {
        "Application": ("Application", "prov:SoftwareAgent"),
        "Port": ("Port", None),
        "Membership": ("Membership", None),
        "Role": ("Role", None),
        "Employee": ("Employee", "prov:Agent"),
    },
    "catalog": {
        "CatalogLOB": ("Catalog Line of Business", "org:OrganizationalUnit"),
        "BusinessSegment": ("Business Segment", "org:FormalOrganization"),
        "ProductLine": ("Product Line", None),
        "Product": ("Product", None),
        "DevTeam": ("Dev Team", "org:OrganizationalUnit"),
        "JiraBoard": ("Jira Board", None),
    },
}

# Local relationships per supplement as
# (local name, edge type, from, to, published property it maps to).
LOCAL_RELATIONSHIPS = {
    "scheduler": [
        ("runsOn", "RUNS_ON", "JobFolder", "ControlMServer", None),
        ("containsJob", "CONTAINS_JOB", "JobFolder", "ControlMJob", "prov:hadMember"),
        ("requiresInCondition", "REQUIRES_IN_CONDITION", "ControlMJob", "Condition", "prov:used"),
        ("emitsOutCondition", "EMITS_OUT_CONDITION", "ControlMJob", "Condition", "prov:generated"),
        ("wasInformedBy", "WAS_INFORMED_BY", "ControlMJob", "ControlMJob", "prov:wasInformedBy"),
    ],
    "applications": [
        ("hasPort", "HAS_PORT", "Application", "Port", None),
        ("hasMembership", "HAS_MEMBERSHIP", "Application", "Membership", "org:hasMembership"),
        ("ofRole", "OF_ROLE", "Membership", "Role", "org:role"),
        ("heldBy", "HELD_BY", "Membership", "Employee", "org:member"),
    ],
    "catalog": [
        ("reconcilesTo", "RECONCILES_TO", "CatalogLOB", "BusinessSegment", None),
        ("hasProductLine", "HAS_PRODUCT_LINE", "CatalogLOB", "ProductLine", None),
        ("hasProduct", "HAS_PRODUCT", "ProductLine", "Product", None),
        ("hasDevTeam", "HAS_DEV_TEAM", "Product", "DevTeam", None),
        ("hasJiraBoard", "HAS_JIRA_BOARD", "DevTeam", "JiraBoard", None),
    ],
}

# Which edge label links two kinds of node, with its published term.
PROVENANCE_MATRIX = [
    ("Activity", "Activity", "prov:wasInformedBy", "WAS_INFORMED_BY"),
    ("Activity", "Entity", "prov:used", "USED"),
    ("Activity", "Entity", "prov:generated", "GENERATED"),
    ("Activity", "Agent", "prov:wasAssociatedWith", "WAS_ASSOCIATED_WITH"),
    ("Entity", "Activity", "prov:wasGeneratedBy", "WAS_GENERATED_BY"),
    ("Entity", "Entity", "prov:wasDerivedFrom", "WAS_DERIVED_FROM"),
    ("Entity", "Agent", "prov:wasAttributedTo", "WAS_ATTRIBUTED_TO"),
    ("Agent", "Agent", "prov:actedOnBehalfOf", "ACTED_ON_BEHALF_OF"),
    ("Collection", "any", "prov:hadMember", "HAD_MEMBER"),
]

# Seed roles (name, source, description).
SEED_ROLES = [
    ("App Owner", "SEAL", "Application owner of record (SEAL)."),
    ("Data Owner", "SEAL", "Data owner accountable for the application's data (SEAL)."),
    ("L2 Operate Manager", "SEAL", "Tier-2 operate manager. Drives support-team derivation (F.4)."),
    ("Risk Manager", "SEAL", "Risk owner (SEAL)."),
    ("CTO", "SEAL", "Chief technology officer for the application (SEAL)."),
    ("Agility Lead", "PAT", "Agile delivery lead for the application (PAT)."),
    ("Software Engineer", "PAT", "Engineer on the application's dev team (PAT, multi-valued)."),
    ("Product Contact", "PAT", "Product-level contact (PAT). Often overlaps CTO."),
]
ROLE_RENAMES = {
    "App Owner": "Application Owner",
    "Data Owner": "Primary Information Owner",
}
# The framework's roles as (name, mandatory, level, description).
FRAMEWORK_ROLES = [
    ("Application Owner", True, "Application",
     "Direct responsibility for the application; maintains records, certifies compliance."),
    ("Primary Information Owner", True, "Application",
     "Primary business leader accountable for data classification, access, risk, "
     "regulatory compliance."),
    ("Backup Information Owner", True, "Application",
     "Delegate for the PIO; maintains identical data access rights; cannot be the same "
     "individual as the PIO."),
    ("CTO", True, "Application",
     "Chief Technology Officer; accountable to LOB CIO for holistic management of "
     "applications within the technology group."),
    ("Design Authority", True, "Application",
     "Responsible for application architecture, alignment with CTO investment strategies, "
     "gatekeeping new application risk profiles."),
    ("Chief Business Technologist", True, "Application",
     "Senior management accountable to the CTO for aligning IT/business planning, "
     "budgeting, technology services."),
    ("L1 Operate Manager", False, "Optional",
     "Leads the business-facing operate team providing front-line application support "
     "(e.g., trading-floor support)."),
    ("L2 Operate Manager", False, "Optional",
     "Leads the back-end support team managing component infrastructure and technical "
     "operations. Drives support-team derivation."),
    ("Backup Application Owner", False, "Optional",
     "Assists the Application Owner with recertifications, record updates, RLI breaks. "
     "Effective 2026-05-18."),
    ("Risk Manager", False, "Production-support convention",
     "Risk owner. Production-support-team convention; NOT in the published SEAL framework spec."),
]
_FRAMEWORK = "SEAL framework"
_USER_CONFIRMED = "user-confirmed (not in SEAL framework spec)"

SCHEDULER_KINDS = [
    ("ControlM", "BMC Control-M", 1),
    ("Autosys", "CA Autosys", 2),
    ("Airflow", "Apache Airflow", 2),
]

# Company, segments and their dated membership.
COMPANY = ("JPMC", "JPMorgan Chase & Co.", "annual report")
SEGMENTS = [
    ("CCB", "Consumer & Community Banking", None),
    ("CIB", "Commercial & Investment Bank", None),
    ("AWM", "Asset & Wealth Management", None),
    ("Corp", "Corporate", None),
    ("CB", "Commercial Banking (pre-Q2-2024, merged into CIB)", True),
]
CURRENT_SEGMENTS = ("CCB", "CIB", "AWM", "Corp")
FORMER_SEGMENTS = ("CCB", "CIB", "CB", "AWM")

# Quality dimensions and the metrics measured under each.
DIMENSIONS = {
    "Completeness": "Whether all required data is present.",
    "Accuracy": "Whether values match a trusted source.",
    "Consistency": "Whether values are consistent across structures and over time.",
    "Timeliness": "Whether data arrives within the agreed SLA.",
    "Integrity": "Whether structural / referential rules hold.",
}
METRICS = [
    ("rowcount_match", "Completeness", "Data file row count matches control file claim."),
    ("null_rate", "Completeness", "Per-column null rate vs threshold."),
    ("hash_match", "Accuracy", "File SHA-256 matches control file hash."),
    ("value_range", "Accuracy", "Numeric values within configured min/max."),
    ("schema_conformance", "Consistency", "Columns and types match the expected schema."),
    ("referential_integrity", "Consistency", "Foreign keys resolve to existing rows."),
    ("freshness_sla", "Timeliness", "Arrival timestamp meets the dataset SLA."),
    ("arrival_latency", "Timeliness", "Time between expected and actual arrival."),
    ("pkey_uniqueness", "Integrity", "Primary keys are unique."),
    ("fkey_validity", "Integrity", "Foreign keys present in parent dataset."),
]
LOADER_AGENT = ("jobweave.loader.v1", "Jobweave Loader v1", "loader")

# Declared keys as name -> (table, columns); the two composite
# keys are the folder-scoped ones.
DECLARED_KEYS = {
    "ontology_iri": ("ontology_term", ("iri",)),
    "asset_id": ("asset", ("id",)),
    "dataproduct_id": ("data_product", ("id",)),
    "dataset_iri": ("dataset", ("iri",)),
    "distribution_id": ("distribution", ("id",)),
    "jobrun_id": ("load_run", ("run_id",)),
    "lineagerun_id": ("lineage_run", ("run_id",)),
    "measurement_id": ("quality_measurement", ("id",)),
    "metric_name": ("dq_metric", ("name",)),
    "dimension_name": ("dq_dimension", ("name",)),
    "company_name": ("company", ("name",)),
    "business_segment": ("business_segment", ("code",)),
    "catalog_lob_id": ("catalog_lob", ("lob_id",)),
    "product_line_id": ("product_line", ("product_line_id",)),
    "product_id": ("product", ("product_id",)),
    "application_seal": ("application", ("seal_id",)),
    "port_unique": ("port", ("parent_seal_id", "kind")),
    "devteam_id": ("dev_team", ("team_id",)),
    "employee_id": ("employee", ("employee_id",)),
    "sn_group_id": ("service_group", ("group_id",)),
    "jira_board_id": ("jira_board", ("board_id",)),
    "role_name": ("role", ("name",)),
    "membership_id": ("membership", ("membership_id",)),
    "scheduler_kind": ("scheduler_kind", ("name",)),
    "controlm_server": ("controlm_server", ("name",)),
    "folder_id": ("job_folder", ("folder_id",)),
    "controlmjob_key": ("controlm_job", ("folder_id", "job_id")),
    "condition_key": ("condition", ("folder_id", "name")),
    "table_qualified": ("distribution", ("database_nm", "schema_nm", "table_nm")),
    "channel_id": ("channel", ("id",)),
    "app_snapshot_id": ("application_snapshot", ("snapshot_id",)),
    "product_snapshot_id": ("product_snapshot", ("snapshot_id",)),
    "lob_snapshot_id": ("catalog_lob_snapshot", ("snapshot_id",)),
}

_TERM_SCHEMA = (
    "iri string, source_label string, label string, notes string, domain string, range string"
)


def _iri(compact: str) -> str:
    prefix, local = compact.split(":", 1)
    return NAMESPACES[prefix] + local


def published_terms(spark: SparkSession) -> DataFrame:
    """Anchor terms of the published vocabularies."""
    notes = {"dprod:DataProduct": "A unit of consumable data, governed by ports + agreements."}
    rows = [
        (NAMESPACES[p] + local, label_set, label, notes.get(f"{p}:{local}"), None, None)
        for label_set, p, members in TERM_SETS
        for local, label in members.items()
    ]
    return literal_table(spark, rows, _TERM_SCHEMA)


def local_terms(
    spark: SparkSession, supplement: str, namespace: str = LOCAL_NAMESPACE
) -> DataFrame:
    """Local classes and relationships of one supplement."""
    classes = [
        (namespace + name, "LocalClass", label, None, None, None)
        for name, (label, _) in LOCAL_CLASSES[supplement].items()
    ]
    relationships = [
        (namespace + name, "LocalRelationship", edge, None, source, target)
        for name, edge, source, target, _ in LOCAL_RELATIONSHIPS[supplement]
    ]
    return literal_table(spark, classes + relationships, _TERM_SCHEMA)


def term_links(
    spark: SparkSession, supplement: str, terms: DataFrame, namespace: str = LOCAL_NAMESPACE
) -> tuple[DataFrame, DataFrame]:
    """``subclass_of`` and ``maps_to`` edges whose published end exists."""
    subclass = [
        (namespace + name, _iri(parent), f"{supplement}_supplement")
        for name, (_, parent) in LOCAL_CLASSES[supplement].items()
        if parent
    ]
    maps = [
        (namespace + name, _iri(term))
        for name, _, _, _, term in LOCAL_RELATIONSHIPS[supplement]
        if term
    ]
    known = terms.select(F.col("iri").alias("to_iri"))
    wanted = literal_table(spark, subclass, "iri string, to_iri string, source string")
    mapped = literal_table(spark, maps, "iri string, to_iri string")
    return wanted.join(known, "to_iri", "left_semi").select("iri", "to_iri", "source"), mapped.join(
        known, "to_iri", "left_semi"
    ).select("iri", "to_iri")


_ROLE_SCHEMA = (
    "name string, source string, description string, mandatory boolean, spec_level string, "
    "spec_source string, deprecated_name string, effective_from date"
)


def seed_roles(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, [(n, s, d, None, None, None, None, None) for n, s, d in SEED_ROLES], _ROLE_SCHEMA
    )


def framework_roles(spark: SparkSession) -> DataFrame:
    from datetime import date

    rows = [
        (
            name, "SEAL", text, mandatory, level,
            _USER_CONFIRMED if name == "Risk Manager" else _FRAMEWORK,
            date(2026, 5, 18) if name == "Backup Application Owner" else None,
        )
        for name, mandatory, level, text in FRAMEWORK_ROLES
    ]
    return literal_table(
        spark,
        rows,
        "name string, source string, description string, mandatory boolean, spec_level string, "
        "spec_source string, effective_from date",
    )


def rename_roles(roles: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename roles in place, each only while the new name is not taken."""
    pairs = (renames or ROLE_RENAMES).items()
    proposed = F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.col("name")]
    taken = roles.select(F.col("name").alias("_new"), F.lit(True).alias("_taken")).distinct()
    fires = F.col("_new").isNotNull() & F.col("_taken").isNull()
    renamed = roles.withColumn("_new", proposed).join(taken, "_new", "left").withColumns(
        {
            "name": F.when(fires, F.col("_new")).otherwise(F.col("name")),
            "deprecated_name": F.when(fires, F.col("name")).otherwise(F.col("deprecated_name")),
            "spec_source": F.when(fires, F.lit(_FRAMEWORK)).otherwise(F.col("spec_source")),
        }
    )
    return renamed.select(*roles.columns)


def scheduler_kinds(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, SCHEDULER_KINDS, "name string, kind_label string, phase_supported int"
    )


def company(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [COMPANY], "name string, legal_name string, source string")


def business_segments(spark: SparkSession) -> DataFrame:
    return literal_table(spark, SEGMENTS, "code string, name string, retired boolean")


def segment_memberships(spark: SparkSession, historical: bool = False) -> DataFrame:
    """Dated company-to-segment edges: current ones, or those before the reorganisation."""
    from datetime import date

    if historical:
        codes, start, end = FORMER_SEGMENTS, date(2010, 1, 1), date(2024, 3, 31)
        source = "annual report (pre-Q2-2024)"
    else:
        codes, start, end = CURRENT_SEGMENTS, date(2024, 4, 1), None
        source = "annual report"
    return literal_table(
        spark,
        [(COMPANY[0], code, start, end, source) for code in codes],
        "company string, segment_code string, effective_from date, effective_to date, source string",
    )


def quality_dimensions(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(DIMENSIONS.items()), "name string, description string")


def quality_metrics(spark: SparkSession) -> DataFrame:
    rows = [(name, text) for name, _, text in METRICS]
    return literal_table(spark, rows, "name string, description string")


def metric_dimensions(spark: SparkSession) -> DataFrame:
    rows = [(name, dimension) for name, dimension, _ in METRICS]
    return literal_table(spark, rows, "metric string, dimension string")


def loader_agent(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [LOADER_AGENT], "id string, label string, kind string")


def provenance_matrix(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, PROVENANCE_MATRIX, "from_type string, to_type string, term string, edge_type string"
    )


# Kinds of nodes that have no class of their own in a supplement.
_OTHER_KINDS = {"Condition": "Entity", "JobRun": "Activity"}
# Agents and collections: the published classes below the kinds of the matrix.
_KIND_OF_CLASS = {
    "prov:Activity": ("Activity",),
    "prov:Agent": ("Agent", "Entity"),
    "prov:SoftwareAgent": ("Agent", "Entity"),
    "prov:Collection": ("Collection", "Entity"),
    "org:OrganizationalUnit": ("Agent", "Entity"),
    "org:FormalOrganization": ("Agent", "Entity"),
}


def node_kinds(spark: SparkSession) -> DataFrame:
    """(label, kind) of nodes in the terms of the matrix.

    What is loaded as a record of something is an entity as well, so it can be
    generated by a run; a class without a published counterpart is only that.
    """
    classes = {name: parent for group in LOCAL_CLASSES.values() for name, (_, parent) in group.items()}
    rows = [(label, kind) for label, kind in _OTHER_KINDS.items()]
    for label, parent in classes.items():
        rows.extend((label, kind) for kind in {*_KIND_OF_CLASS.get(parent, ()), "Entity"})
    return literal_table(spark, sorted(rows), "label string, kind string")


def edge_registry(spark: SparkSession) -> DataFrame:
    """Declared edges: the local relationships and the cross-domain provenance edge."""
    domains = {"scheduler": "controlm", "applications": "seal", "catalog": "catalog"}
    prefixes = {"scheduler": "m3", "applications": "seal", "catalog": "catalog"}
    rows = [
        (
            f"{prefixes[group]}_{edge.lower()}", edge, source, target,
            term if term and term.startswith("prov:") else None, domains[group], "active",
        )
        for group, edges in LOCAL_RELATIONSHIPS.items()
        for _, edge, source, target, term in edges
    ]
    rows.append(
        ("prov_was_generated_by", "WAS_GENERATED_BY", "*", "JobRun", "prov:wasGeneratedBy", "all",
         "active")
    )
    return literal_table(
        spark,
        rows,
        "id string, edge_type string, from_node string, to_node string, term string, "
        "domain string, status string",
    )
