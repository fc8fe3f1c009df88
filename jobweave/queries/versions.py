"""History queries: versions, pruning, dated joins, state hashes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import history
from jobweave.operators.extras import version_changes
from jobweave.queries.registry import query, table
from jobweave.session import RunClock
from jobweave.sinks.tables import TableSet
from jobweave.sinks.versions import VersionTable
from jobweave.sources.files import StagedFolder, stage
from jobweave.sources.vocabulary import segment_memberships


def _monthly_states(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct order statuses per customer and month."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("entity_key"), month.alias("day"))
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("o_orderstatus"))).alias("state"))
        .withColumn("hash", F.sha2("state", 256))
    )


_VERSIONS_SQL = """
    WITH states AS (
      SELECT o_custkey AS entity_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS day,
             string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS state
      FROM orders GROUP BY ALL),
    marked AS (
      SELECT *, lag(state) OVER (PARTITION BY entity_key ORDER BY day) AS before FROM states),
    versions AS (
      SELECT entity_key, state, sha256(state) AS hash, day AS valid_from,
             lead(day) OVER (PARTITION BY entity_key ORDER BY day) AS valid_to
      FROM marked WHERE state IS DISTINCT FROM before)
"""


@query(
    _VERSIONS_SQL
    + """SELECT entity_key, state, hash, CAST(valid_from AS VARCHAR) AS valid_from,
                CAST(valid_to AS VARCHAR) AS valid_to FROM versions"""
)
def scd2_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of a state over time: a new one only where the hash differs."""
    versions = history.versions_of_dated_states(
        _monthly_states(spark, folder), "entity_key", "day", "hash"
    )
    return versions.select(
        "entity_key", "state", "hash",
        F.col("valid_from").cast("string").alias("valid_from"),
        F.col("valid_to").cast("string").alias("valid_to"),
    )


_RUNS = ("1996-12-31", "1998-12-31", "2001-12-31")

_PERIOD_STATES_SQL = """
    WITH periods AS (
      SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN DATE '1996-12-31'
                     WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN DATE '1998-12-31'
                     ELSE DATE '2001-12-31' END AS day
      FROM orders),
    states AS (
      SELECT CAST(o_custkey AS VARCHAR) AS entity_key, day,
             '{"priorities": [' || string_agg(DISTINCT '"' || o_orderpriority || '"', ', '
                ORDER BY '"' || o_orderpriority || '"') || '], "statuses": [' ||
             string_agg(DISTINCT '"' || o_orderstatus || '"', ', '
                ORDER BY '"' || o_orderstatus || '"') || ']}' AS state_json
      FROM periods GROUP BY ALL)
"""


def _period_state(spark: SparkSession, folder: str, start: str | None, end: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    day = F.col("o_orderdate").cast("date")
    chosen = orders.filter(day <= F.lit(end).cast("date"))
    if start:
        chosen = chosen.filter(day > F.lit(start).cast("date"))
    state = chosen.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(
        F.collect_set("o_orderstatus").alias("statuses"),
        F.collect_set("o_orderpriority").alias("priorities"),
    )
    return history.hashed_state(state, "id")


@query(
    _PERIOD_STATES_SQL
    + """,
    marked AS (
      SELECT *, lag(state_json) OVER (PARTITION BY entity_key ORDER BY day) AS before FROM states)
    SELECT entity_key, state_json, sha256(state_json) AS hash,
           CAST(day AS VARCHAR) AS valid_from,
           CAST(lead(day) OVER (PARTITION BY entity_key ORDER BY day) AS VARCHAR) AS valid_to
    FROM marked WHERE state_json IS DISTINCT FROM before
    """
)
def scd2_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The version step run after run: compare with the open versions, close, open.

    Each run replaces open versions of changed customers and adds the closed ones as
    its own part.
    """
    tables = TableSet(spark, StagedFolder(spark, "history").root)
    versions = VersionTable(tables, "customer_version", buckets=4)
    for previous, run_day in zip((None, *_RUNS), _RUNS):
        clock = RunClock(run_id=run_day, loaded_at=f"{run_day} 00:00:00")
        state = _period_state(spark, folder, previous, run_day)
        compared = stage(history.compare_states(state, versions.open_versions()), "compared")
        versions.advance(compared, clock)
    return tables.read("customer_version").select(
        "entity_key", "state_json", "hash",
        F.col("valid_from").cast("string").alias("valid_from"),
        F.col("valid_to").cast("string").alias("valid_to"),
    )


def _version_table(spark: SparkSession, folder: str) -> DataFrame:
    versions = history.versions_of_dated_states(
        _monthly_states(spark, folder), "entity_key", "day", "hash"
    )
    return versions.select(
        F.concat_ws("|", F.col("entity_key").cast("string"), F.col("day").cast("string")).alias("snapshot_id"),
        "entity_key", "hash", F.col("state").alias("state_json"), "valid_from", "valid_to",
        F.col("valid_from").cast("timestamp").alias("created_at"),
    )


_PRUNE_DATE = date(2005, 1, 1)
_RANKED_SQL = _VERSIONS_SQL + """,
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY valid_from DESC) AS n
      FROM versions)
"""


@query(
    _RANKED_SQL
    + """SELECT entity_key, hash, CAST(valid_from AS VARCHAR) AS valid_from,
                CAST(valid_to AS VARCHAR) AS valid_to
         FROM ranked WHERE n = 1 OR valid_from >= DATE '2005-01-01' - 5 * 365"""
)
def prune_keep_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Versions past retention go, except each entity's newest."""
    kept = history.prune_versions(_version_table(spark, folder), _PRUNE_DATE)
    return kept.select(
        "entity_key", "hash",
        F.col("valid_from").cast("string").alias("valid_from"),
        F.col("valid_to").cast("string").alias("valid_to"),
    )


@query(
    _RANKED_SQL
    + """SELECT count(*) AS deleted FROM ranked
         WHERE n > 1 AND valid_from < DATE '2005-01-01' - 5 * 365"""
)
def prune_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many versions the pruning deletes."""
    counted = history.pruned_count(_version_table(spark, folder), _PRUNE_DATE)
    return counted.select(F.col("deleted").cast("bigint").alias("deleted"))


@query(
    """
    WITH eras AS (
      SELECT DISTINCT c_mktsegment AS segment, era, effective_from, effective_to
      FROM customer, (VALUES ('early', DATE '1995-01-01', DATE '1997-06-30'),
                             ('late', DATE '1997-07-01', CAST(NULL AS DATE)))
                     v(era, effective_from, effective_to))
    SELECT o_orderkey, segment, era
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN eras ON c_mktsegment = segment
    WHERE CAST(o_orderdate AS DATE) >= effective_from
      AND (effective_to IS NULL OR CAST(o_orderdate AS DATE) <= effective_to)
    """
)
def effective_dated_join(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with the dated row of their key in force on their day."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment")
    )

    def era(name: str, start: str, end: str | None) -> object:
        return F.struct(
            F.lit(name).alias("era"),
            F.lit(start).cast("date").alias("effective_from"),
            F.lit(end).cast("date").alias("effective_to"),
        )

    eras = F.array(era("early", "1995-01-01", "1997-06-30"), era("late", "1997-07-01", None))
    ranges = customers.select("segment").distinct().select("segment", F.inline(eras))
    orders = table(spark, folder, "orders")
    facts = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey", "segment", F.col("o_orderdate").cast("date").alias("day")
    )
    return history.effective_join(facts, ranges, "day", ["segment"]).select(
        "o_orderkey", "segment", "era"
    )


@query(
    """
    WITH facts AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 9500 AS day FROM orders),
    ranges AS (
      SELECT * FROM (VALUES
        ('CCB', DATE '2024-04-01', CAST(NULL AS DATE)), ('CIB', DATE '2024-04-01', NULL),
        ('AWM', DATE '2024-04-01', NULL), ('Corp', DATE '2024-04-01', NULL),
        ('CCB', DATE '2010-01-01', DATE '2024-03-31'), ('CIB', DATE '2010-01-01', DATE '2024-03-31'),
        ('CB', DATE '2010-01-01', DATE '2024-03-31'), ('AWM', DATE '2010-01-01', DATE '2024-03-31')
      ) v(segment_code, effective_from, effective_to))
    SELECT CAST(year(day) AS INTEGER) AS year, segment_code, count(*) AS orders
    FROM facts JOIN ranges ON day >= effective_from
     AND (effective_to IS NULL OR day <= effective_to)
    GROUP BY ALL
    """
)
def point_in_time_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments in force on each order's (shifted) day, met by the intervals that hold the day."""
    ranges = segment_memberships(spark).unionByName(segment_memberships(spark, historical=True))
    facts = table(spark, folder, "orders").select(
        "o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 9500).alias("day")
    )
    joined = history.effective_join(facts, ranges, "day")
    return joined.groupBy(F.year("day").alias("year"), "segment_code").agg(
        F.count(F.lit(1)).alias("orders")
    )


@query(
    """
    WITH lists AS (
      SELECT o_custkey, string_agg(DISTINCT '"' || o_orderpriority || '"', ', '
               ORDER BY '"' || o_orderpriority || '"') AS ids
      FROM orders GROUP BY o_custkey),
    states AS (
      SELECT CAST(c_custkey AS VARCHAR) AS entity_key,
             '{"contact_ids": [' || coalesce(ids, '') || '], "name": "' || c_name ||
             '", "nation": ' || c_nationkey || ', "operate": ' ||
             CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || ', "product_id": null}'
             AS state_json
      FROM customer LEFT JOIN lists ON o_custkey = c_custkey)
    SELECT entity_key, state_json, sha256(state_json) AS hash FROM states
    """
)
def entity_state_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical state text of each entity with sorted member lists, and its digest."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        (F.col("c_acctbal") > 0).alias("operate"),
        F.lit(None).cast("string").alias("product_id"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), "o_orderpriority"
    )
    members = history.sorted_members(orders, "id", "o_orderpriority", "contact_ids")
    return history.hashed_state(customers.join(members, "id", "left"), "id")


@query(
    _PERIOD_STATES_SQL.replace("states AS (", "states_unused AS (SELECT 1), flat AS (").replace(
        "'{\"priorities\": [' || string_agg(DISTINCT '\"' || o_orderpriority || '\"', ', '\n"
        "                ORDER BY '\"' || o_orderpriority || '\"') || '], \"statuses\": [' ||\n"
        "             string_agg(DISTINCT '\"' || o_orderstatus || '\"', ', '\n"
        "                ORDER BY '\"' || o_orderstatus || '\"') || ']}' AS state_json",
        "string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities,\n"
        "             string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses",
    )
    + """,
    marked AS (
      SELECT *, row_number() OVER w AS n, lag(priorities) OVER w AS p, lag(statuses) OVER w AS s
      FROM flat WINDOW w AS (PARTITION BY entity_key ORDER BY day))
    SELECT entity_key, CAST(day AS VARCHAR) AS valid_from,
           concat_ws(',', CASE WHEN priorities IS DISTINCT FROM p THEN 'priorities' END,
                     CASE WHEN statuses IS DISTINCT FROM s THEN 'statuses' END) AS changed
    FROM marked WHERE n > 1
    """
)
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Which fields changed from one snapshot to the next."""
    day = F.col("o_orderdate").cast("date")
    bounds = [F.lit(d).cast("date") for d in _RUNS]
    period = F.when(day <= bounds[0], bounds[0]).when(day <= bounds[1], bounds[1]).otherwise(bounds[2])
    states = table(spark, folder, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("entity_key"), period.alias("valid_from")
    ).agg(
        F.concat_ws(",", F.array_sort(F.collect_set("o_orderpriority"))).alias("priorities"),
        F.concat_ws(",", F.array_sort(F.collect_set("o_orderstatus"))).alias("statuses"),
    )
    dated = states.withColumns(
        {"created_at": F.col("valid_from").cast("timestamp"), "snapshot_id": F.lit("")}
    )
    return version_changes(dated, ["priorities", "statuses"]).select(
        "entity_key",
        F.col("valid_from").cast("string").alias("valid_from"),
        F.concat_ws(",", "changed_fields").alias("changed"),
    )
