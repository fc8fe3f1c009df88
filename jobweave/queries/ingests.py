"""Whole chains over the driver tables: row specs, loads, derived dependencies and what they leave behind."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.plans import chains
from jobweave.queries.registry import query, table
from jobweave.session import RunClock
from jobweave.sinks.tables import TableSet
from jobweave.sources import specs
from jobweave.sources.files import StagedFolder
from jobweave.sources.readers import Source


def _extract(rows: DataFrame, name: str, cells: Mapping[str, Column]) -> Source:
    """An extract with every column of its spec as text; what is not given is NULL."""
    blank = F.lit(None)
    columns = [cells.get(n, blank).cast("string").alias(n) for n in specs.SPECS[name].names]
    return Source("frame", rows.select(*columns))


def _scheduler(spark: SparkSession, folder: str) -> dict[str, Source]:
    """Nations as folders, suppliers as jobs; a job waits for the one with half its number.

    Folders of region 0 are idle and those of region 4 have no name; jobs in debt have no version.
    """
    nations, suppliers = table(spark, folder, "nation"), table(spark, folder, "supplier")
    job, of, half = F.col("s_suppkey"), F.col("s_nationkey"), F.floor(F.col("s_suppkey") / 2)
    one, now = F.lit("1"), F.lit("2026-01-02 03:00:00")
    link = {"folder_id": of, "job_id": job, "version_serial": one, "is_current_version": one, "capture_date": now}
    return {
        "controlm_folders": _extract(
            nations, "controlm_folders",
            {
                "folder_id": F.col("n_nationkey"),
                "sched_table": F.when(F.col("n_regionkey") == 4, "").otherwise(F.col("n_name")),
                "data_center": F.concat(F.lit("S"), F.col("n_regionkey").cast("string")),
                "user_daily": F.when(F.col("n_regionkey") == 0, "").otherwise("Y"),
            },
        ),
        "controlm_jobs": _extract(
            suppliers, "controlm_jobs",
            {
                **link,
                "version_serial": F.when(F.col("s_acctbal") >= 0, "1").otherwise(""),
                "job_name": F.col("s_name"),
                "parent_table": of,
                "is_current_version": F.when(job % 2 == 0, "1").otherwise("0"),
            },
        ),
        "controlm_conditions_in": _extract(
            suppliers.filter(job > 0), "controlm_conditions_in",
            {**link, "condition_name": F.concat(F.lit("DONE-"), half.cast("string")), "order_": one},
        ),
        "controlm_conditions_out": _extract(
            suppliers, "controlm_conditions_out",
            {**link, "condition_name": F.concat(F.lit("DONE-"), job.cast("string")), "sign": F.lit("+")},
        ),
    }


@query(
    """
    WITH RECURSIVE job AS (
      SELECT s_suppkey AS id, s_nationkey AS f, s_name AS name, s_acctbal >= 0 AS whole, n_regionkey AS region
      FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    kept AS (SELECT * FROM job WHERE whole AND region <> 4),
    running AS (SELECT * FROM kept WHERE region <> 0),
    edge AS (
      SELECT c.id, c.f, p.id AS before, p.f AS before_f, 1 AS level
      FROM running c JOIN running p ON c.id > 0 AND p.id = c.id // 2
      UNION ALL
      SELECT e.id, e.f, p.id, p.f, level + 1
      FROM edge e JOIN running p ON e.before > 0 AND p.id = e.before // 2 WHERE level < 10),
    wait AS (SELECT id, f, 'DONE-' || id // 2 AS name FROM job WHERE id > 0),
    post AS (SELECT id, f, 'DONE-' || id AS name FROM job),
    lost AS (
      SELECT id, f, '' AS name FROM job WHERE whole AND region = 4
      UNION ALL SELECT * FROM wait WHERE id NOT IN (SELECT id FROM kept)
      UNION ALL SELECT * FROM post WHERE id NOT IN (SELECT id FROM kept))
    SELECT 'folder' AS kind, CAST(n_nationkey AS VARCHAR) AS folder, n_name AS item,
           'S' || n_regionkey || CASE WHEN n_regionkey = 0 THEN ' idle' ELSE ' active' END AS detail
    FROM nation WHERE n_regionkey <> 4
    UNION ALL SELECT 'job', CAST(f AS VARCHAR), CAST(id AS VARCHAR),
           name || CASE WHEN id % 2 = 0 THEN ' current' ELSE ' former' END FROM kept
    UNION ALL SELECT 'requires', CAST(f AS VARCHAR), CAST(id AS VARCHAR), name FROM wait WHERE id IN (SELECT id FROM kept)
    UNION ALL SELECT 'emits', CAST(f AS VARCHAR), CAST(id AS VARCHAR), name FROM post WHERE id IN (SELECT id FROM kept)
    UNION ALL SELECT 'informed by', CAST(f AS VARCHAR), CAST(id AS VARCHAR), before_f || ' ' || before || ' ' || level FROM edge
    UNION ALL SELECT 'rejected', CAST(n_nationkey AS VARCHAR), '', '' FROM nation WHERE n_regionkey = 4
    UNION ALL SELECT 'rejected', CAST(f AS VARCHAR), CAST(id AS VARCHAR), '' FROM job WHERE NOT whole
    UNION ALL SELECT 'unmatched', CAST(f AS VARCHAR), CAST(id AS VARCHAR), name FROM lost
    """
)
def ingest_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The scheduler chain over all suppliers and nations: its nodes, edges, rejected and unmatched rows.

    Idle folders and their jobs are loaded, but no dependency leads through them.
    """
    tables = TableSet(spark, StagedFolder(spark, "ingest-chain").root)
    clock = RunClock("ingest-chain", "2026-01-05 06:00:00")
    chains.ingest_scheduler(tables, _scheduler(spark, folder), clock)

    def told(kind: str, rows: DataFrame, of: Column, item: Column, detail: Column) -> DataFrame:
        cells = {"folder": of, "item": item, "detail": detail}
        return rows.select(F.lit(kind).alias("kind"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in cells.items()])

    def cell(row: str, name: str) -> Column:
        return F.get_json_object(row, f"$.{name}")

    of, job = F.col("folder_id"), F.col("job_id")
    state = F.when(F.col("active"), " active").otherwise(" idle")
    version = F.when(F.col("active"), " current").otherwise(" former")
    before = F.concat_ws(" ", "predecessor_folder_id", "predecessor_job_id", F.col("recursion_level").cast("string"))
    folders = tables.read("job_folder").join(tables.read("runs_on").select("folder_id", "server"), "folder_id")
    return (
        told("folder", folders, of, F.col("sched_table"), F.concat("server", state))
        .unionByName(told("job", tables.read("controlm_job"), of, job, F.concat("job_name", version)))
        .unionByName(told("requires", tables.read("requires_in_condition"), of, job, F.col("name")))
        .unionByName(told("emits", tables.read("emits_out_condition"), of, job, F.col("name")))
        .unionByName(told("informed by", tables.read("was_informed_by"), of, job, before))
        .unionByName(
            told("rejected", tables.read("rejected_row"), cell("raw", "folder_id"), cell("raw", "job_id"), F.lit(""))
        )
        .unionByName(
            told("unmatched", tables.read("unmatched_row"),
                 cell("row", "folder_id"), cell("row", "job_id"), cell("row", "condition_name"))
        )
    )


#: A priority of orders stands for a role, as extracts spell it; the role it is stored as is NULL if there is none such.
_ROLES = {
    "1-URGENT": ("cto", "CTO"),
    "2-HIGH": ("bio", "Backup Information Owner"),
    "3-MEDIUM": ("Risk Manager", "Risk Manager"),
    "4-NOT SPECIFIED": ("Chief Dreamer", None),
    "5-LOW": ("L2 Ops Manager", "L2 Operate Manager"),
}


def _reference(spark: SparkSession, folder: str) -> dict[str, Source]:
    """Regions as lines of business, nations as product lines, parts as products, suppliers as teams,
    customers as applications, orders as contacts.

    One region has an impossible confidence, and some products belong to a line that is not there.
    """
    region, nation, part = F.col("r_regionkey"), F.col("n_nationkey"), F.col("p_partkey")
    blank = F.lit("")
    role = F.coalesce(*[F.when(F.col("o_orderpriority") == p, spelt) for p, (spelt, _) in _ROLES.items()])
    sources = {
        "catalog_lobs": ("region", {
            "lob_id": region, "code": F.concat(F.lit("L"), region.cast("string")), "name": F.col("r_name"),
            "reconciles_to_segment": F.when(region < 2, "CIB").otherwise(blank),
            "reconcile_confidence": F.when(region == 4, "1.4").otherwise("0.5"),
        }),
        "product_lines": ("nation", {
            "product_line_id": nation, "name": F.col("n_name"), "parent_lob_id": F.col("n_regionkey"),
        }),
        "products": ("part", {
            "product_id": F.concat(F.lit("P"), part.cast("string")), "name": F.col("p_name"),
            "parent_product_line_id": part % 30,
        }),
        "dev_teams": ("supplier", {
            "team_id": F.col("s_suppkey"), "name": F.col("s_name"),
            "jira_board_id": F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("B"), F.col("s_suppkey").cast("string"))).otherwise(blank),
            "parent_product_id": F.concat(F.lit("P"), F.col("s_suppkey").cast("string")),
        }),
        "seal_applications": ("customer", {
            "app_id": F.col("c_custkey"), "name": F.col("c_name"), "app_state": F.lit("Operate"),
            "overall_risk_rating": F.col("c_mktsegment"),
            "app_owner_sid": F.concat(F.lit("E"), F.col("c_nationkey").cast("string")),
            "app_owner_name": F.col("c_name"),
        }),
        "seal_contacts": ("orders", {
            "app_id": F.col("o_custkey"), "role_name": role,
            "employee_sid": F.concat(F.lit("S"), F.col("o_orderstatus")),
            "employee_name": F.col("o_orderstatus"),
        }),
    }
    return {name: _extract(table(spark, folder, source), name, cells) for name, (source, cells) in sources.items()}


_ROLE_SQL = " ".join(f"WHEN '{p}' THEN '{name}'" for p, (_, name) in _ROLES.items() if name)


@query(
    f"""
    WITH contact AS (
      SELECT CAST(c_custkey AS VARCHAR) AS app, 'Application Owner' AS role, 'E' || c_nationkey AS person FROM customer
      UNION
      SELECT CAST(o_custkey AS VARCHAR), CASE o_orderpriority {_ROLE_SQL} END AS role, 'S' || o_orderstatus
      FROM orders WHERE role IS NOT NULL),
    line AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey AS lob FROM nation),
    product AS (SELECT 'P' || p_partkey AS id, p_name AS name, CAST(p_partkey % 30 AS VARCHAR) AS line FROM part),
    team AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, 'P' || s_suppkey AS product, s_acctbal >= 0 AS board FROM supplier)
    SELECT 'line of lob' AS kind, id AS item, CAST(lob AS VARCHAR) AS detail FROM line WHERE lob <> 4
    UNION ALL SELECT 'product of line', id, line FROM product WHERE line IN (SELECT id FROM line)
    UNION ALL SELECT 'team of product', id, product FROM team
    UNION ALL SELECT 'board of team', id, 'B' || id FROM team WHERE board
    UNION ALL SELECT 'segment of lob', CAST(r_regionkey AS VARCHAR), 'CIB' FROM region WHERE r_regionkey < 2
    UNION ALL SELECT 'member', app || '|SEAL|' || role || '|' || person, role FROM contact
    UNION ALL SELECT 'application state', app, any_value(c_mktsegment) || ' ["' || string_agg(DISTINCT person, '","' ORDER BY person) || '"]'
      FROM contact JOIN customer ON CAST(c_custkey AS VARCHAR) = app GROUP BY app
    UNION ALL SELECT 'product state', coalesce(p.id, t.product), coalesce(p.name, '')
      FROM product p FULL JOIN (SELECT DISTINCT product FROM team) t ON t.product = p.id
    UNION ALL SELECT 'lob state', CAST(r_regionkey AS VARCHAR),
           '["' || (SELECT string_agg(id, '","' ORDER BY id) FROM line WHERE lob = r_regionkey) || '"]'
      FROM region WHERE r_regionkey <> 4
    UNION ALL SELECT 'rejected', CAST(r_regionkey AS VARCHAR), '' FROM region WHERE r_regionkey = 4
    UNION ALL SELECT 'rejected', CAST(o_custkey AS VARCHAR), 'Chief Dreamer' FROM orders
      WHERE CASE o_orderpriority {_ROLE_SQL} END IS NULL
    UNION ALL SELECT 'unmatched', id, CAST(lob AS VARCHAR) FROM line WHERE lob = 4
    UNION ALL SELECT 'unmatched', id, line FROM product WHERE line NOT IN (SELECT id FROM line)
    """
)
def refresh_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabularies, then the reference chain and its snapshots over six tables: edges, members, states, lost rows."""
    tables = TableSet(spark, StagedFolder(spark, "refresh-chain").root)
    chains.bootstrap(tables)
    chains.refresh_reference(tables, _reference(spark, folder), RunClock("refresh-chain", "2026-01-05 06:00:00"))

    def told(kind: str, name: str, item: Column, detail: Column) -> DataFrame:
        return tables.read(name).select(
            F.lit(kind).alias("kind"), item.alias("item"), F.coalesce(detail, F.lit("")).alias("detail")
        )

    def cell(row: str, *names: str) -> Column:
        return F.coalesce(*[F.get_json_object(row, f"$.{n}") for n in names])

    key = F.col("entity_key")
    state = F.concat_ws(" ", cell("state_json", "risk_level"), cell("state_json", "contact_ids"))
    parts = (
        told("line of lob", "has_product_line", F.col("product_line_id"), F.col("lob_id")),
        told("product of line", "has_product", F.col("product_id"), F.col("product_line_id")),
        told("team of product", "has_dev_team", F.col("team_id"), F.col("product_id")),
        told("board of team", "has_jira_board", F.col("team_id"), F.col("board_id")),
        told("segment of lob", "reconciles_to", F.col("lob_id"), F.col("segment_code")),
        told("member", "of_role", F.col("membership_id"), F.col("role_name")),
        told("application state", "application_snapshot", key, state),
        told("product state", "product_snapshot", key, cell("state_json", "name")),
        told("lob state", "catalog_lob_snapshot", key, cell("state_json", "product_line_ids")),
        told("rejected", "rejected_row", cell("raw", "lob_id", "app_id"), cell("raw", "role_name")),
        told("unmatched", "unmatched_row", cell("row", "product_id", "product_line_id"),
             cell("row", "parent_product_line_id", "parent_lob_id")),
    )
    return reduce(DataFrame.unionByName, parts)
