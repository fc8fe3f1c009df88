"""Merge queries: node and edge upserts, shared nodes, renames, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.history import latest_per_key
from jobweave.operators.upsert import Merge, provenance, rename_keys, union_in_order, upsert, without_order
from jobweave.operators.validate import Field, RowSpec
from jobweave.plans.loads import Load, Write, run_load
from jobweave.queries.registry import SQL, query, table
from jobweave.session import RunClock
from jobweave.sinks.tables import TableSet
from jobweave.sources.files import StagedFolder, shared_folder
from jobweave.sources.readers import with_sequence
from jobweave.sources.vocabulary import rename_roles
from jobweave.streaming.micro_batch import file_stream, in_time, merge_stream


def _order_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a batch keyed by customer, ordered by date and key."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("first_order"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("last_priority"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("urgent_order"),
        F.struct("o_orderdate", "o_orderkey").alias("_seq"),
    )


_MERGE = Merge(("id",), ("first_order",), ("status", "last_priority"), ("urgent_order",))


@query(
    """
    WITH old AS (
      SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS id, -1 AS first_order,
             'old' AS status, c_mktsegment AS last_priority, -c_custkey AS urgent_order, c_name AS name
      FROM customer),
    new AS (
      SELECT o_custkey AS id,
             arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS first_order,
             arg_max(struct_pack(s := o_orderstatus,
                                 p := CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END),
                     struct_pack(d := o_orderdate, k := o_orderkey)) AS last_row,
             arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey))
               FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_order
      FROM orders GROUP BY o_custkey)
    SELECT coalesce(old.id, new.id) AS id,
           CAST(CASE WHEN old.id IS NOT NULL THEN old.first_order ELSE new.first_order END AS BIGINT)
             AS first_order,
           CASE WHEN new.id IS NOT NULL THEN new.last_row.s ELSE old.status END AS status,
           CASE WHEN new.id IS NOT NULL THEN new.last_row.p ELSE old.last_priority END
             AS last_priority,
           coalesce(new.urgent_order, old.urgent_order) AS urgent_order, old.name
    FROM old FULL JOIN new ON old.id = new.id
    """
)
def upsert_first_last(spark: SparkSession, folder: str) -> DataFrame:
    """First-wins, last-wins and keep-old columns merged into an existing table.

    Customers in debt stand in it under another id, so rows are created, updated and kept.
    """
    old = table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("id"),
        F.lit(-1).cast("bigint").alias("first_order"),
        F.lit("old").alias("status"),
        F.col("c_mktsegment").alias("last_priority"),
        (-F.col("c_custkey")).alias("urgent_order"),
        F.col("c_name").alias("name"),
    )
    return upsert(old, _order_batch(spark, folder), _MERGE)


@query(SQL["upsert_first_last"])
def upsert_touched_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The same merge into a stored table of 16 buckets of its keys.

    A batch reads and replaces only the buckets of its customers. A batch without
    rows, and the same batch again, change nothing.
    """
    tables = TableSet(spark, StagedFolder(spark, "bucketed").root, buckets={"customer": 16})
    old = table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("id"),
        F.lit(-1).cast("bigint").alias("first_order"),
        F.lit("old").alias("status"),
        F.col("c_mktsegment").alias("last_priority"),
        (-F.col("c_custkey")).alias("urgent_order"),
        F.col("c_name").alias("name"),
    )
    tables.write("customer", old)
    tables.merge("customer", _order_batch(spark, folder), _MERGE)
    tables.merge("customer", _order_batch(spark, folder).filter("false"), _MERGE)
    tables.merge("customer", _order_batch(spark, folder), _MERGE)
    return tables.read("customer")


_COLLAPSED_SQL = """
    SELECT o_custkey AS id,
           arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS first_order,
           arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS status,
           arg_max(struct_pack(p := CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END),
                   struct_pack(d := o_orderdate, k := o_orderkey)).p AS last_priority,
           arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey))
             FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_order
    FROM orders GROUP BY o_custkey
"""


@query(_COLLAPSED_SQL)
def upsert_twice(spark: SparkSession, folder: str) -> DataFrame:
    """The same batch merged twice gives what merging it once gives."""
    batch = _order_batch(spark, folder)
    return upsert(upsert(None, batch, _MERGE), batch, _MERGE)


@query(
    """
    SELECT o_custkey AS customer, l_suppkey AS supplier, l_returnflag AS via,
           CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_seen,
           CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_seen
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
    """
)
def edge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Edges keyed by both ends and a property, first and last seen."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem")
    day = F.col("l_shipdate").cast("date")
    batch = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("customer"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_returnflag").alias("via"),
        day.alias("first_seen"),
        day.alias("last_seen"),
        day.alias("_seq"),
    )
    merge = Merge(("customer", "supplier", "via"), ("first_seen",), ("last_seen",))
    edges = upsert(None, batch, merge)
    return edges.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


@query(
    """
    WITH both_sides AS (
      SELECT l_partkey AS name, 'required' AS source, 0 AS side, l_shipdate AS d,
             l_orderkey AS k, l_linenumber AS n
      FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL
      SELECT l_partkey, 'emitted', 1, l_shipdate, l_orderkey, l_linenumber
      FROM lineitem WHERE l_returnflag <> 'R')
    SELECT name, arg_min(source, side) AS source,
           arg_max(k, struct_pack(side := side, d := d, k := k, n := n)) AS last_order
    FROM both_sides GROUP BY name
    """
)
def shared_condition_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One node per name from two sources; the first source's rows come first."""
    lines = table(spark, folder, "lineitem")

    required = F.col("l_returnflag") == "R"

    def side(rows: Column, source: str) -> DataFrame:
        return lines.filter(rows).select(
            F.col("l_partkey").alias("name"),
            F.lit(source).alias("source"),
            F.col("l_orderkey").alias("last_order"),
            F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("_seq"),
        )

    batch = union_in_order(side(required, "required"), side(~required, "emitted"))
    return upsert(None, batch, Merge(("name",), ("source",), ("last_order",)))


@query(
    """
    WITH edges AS (
      SELECT o_custkey AS folder_id, o_orderpriority AS server, min(o_orderdate) AS since,
             max(struct_pack(d := o_orderdate, k := o_orderkey)) AS last
      FROM orders GROUP BY ALL)
    SELECT folder_id, count(*) AS servers, arg_max(server, last) AS current_server,
           CAST(CAST(arg_max(since, last) AS DATE) AS VARCHAR) AS since
    FROM edges GROUP BY folder_id
    """
)
def migration_trail(spark: SparkSession, folder: str) -> DataFrame:
    """Every server a folder ran on stays an edge; the last seen one is current."""
    batch = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("folder_id"),
        F.col("o_orderpriority").alias("server"),
        F.col("o_orderdate").alias("since"),
        F.struct("o_orderdate", "o_orderkey").alias("last_seen"),
        F.struct("o_orderdate", "o_orderkey").alias("_seq"),
    )
    edges = upsert(None, batch, Merge(("folder_id", "server"), ("since",), ("last_seen",)))
    counted = edges.groupBy("folder_id").agg(
        F.count(F.lit(1)).alias("servers"),
        F.max_by(F.struct("server", "since"), F.col("last_seen")).alias("_now"),
    )
    return counted.select(
        "folder_id",
        "servers",
        F.col("_now.server").alias("current_server"),
        F.date_format("_now.since", "yyyy-MM-dd").alias("since"),
    )


@query(
    """
    SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey))
             AS o_orderkey,
           arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderstatus
    FROM orders GROUP BY o_custkey
    """
)
def latest_per_entity(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every entity."""
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"
    )
    newest = latest_per_key(orders, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))
    return newest.drop("o_orderdate")


@query(
    """
    SELECT DISTINCT l_suppkey, l_returnflag, 'run-1' AS run_id, 'BMC' AS source FROM lineitem
    """
)
def provenance_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One edge per loaded entity to the run that loaded it."""
    edges = provenance(
        table(spark, folder, "lineitem"), ["l_suppkey", "l_returnflag"], "run-1", "BMC",
        F.lit("2024-01-01 00:00:00").cast("timestamp"),
    )
    return edges.drop("first_seen_at", "last_seen_at")


@query(
    """
    SELECT DISTINCT l_suppkey AS id, 'run-1' AS run_id, 'lines' AS source,
           '2024-01-01' AS first_seen, '2024-01-01' AS last_seen FROM lineitem
    UNION ALL
    SELECT s_suppkey, 'run-2', 'suppliers', '2024-01-02', '2024-01-03' FROM supplier
    """
)
def provenance_two_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Edges to the runs that loaded a supplier; each run is a part, and the second one is replayed a day later."""
    tables = TableSet(spark, StagedFolder(spark, "provenance").root)
    merge = Merge(("id", "run_id", "source"), ("first_seen",), ("last_seen",))

    def edges(name: str, key: str, run: str, source: str, day: str) -> DataFrame:
        rows = table(spark, folder, name).select(F.col(key).alias("id"))
        seen = provenance(rows, ["id"], run, source, F.lit(day))
        return seen.withColumnsRenamed({"first_seen_at": "first_seen", "last_seen_at": "last_seen"})

    for batch in (
        edges("lineitem", "l_suppkey", "run-1", "lines", "2024-01-01"),
        edges("supplier", "s_suppkey", "run-2", "suppliers", "2024-01-02"),
        edges("supplier", "s_suppkey", "run-2", "suppliers", "2024-01-03"),
    ):
        tables.merge("supplier_was_generated_by", batch, merge, collapsed=True)
    return tables.read("supplier_was_generated_by")


@query(
    """
    WITH seen AS (SELECT DISTINCT c_mktsegment AS name FROM customer)
    SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS name,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'BUILDING' END AS deprecated_name,
           count(*) AS holders
    FROM customer GROUP BY ALL
    """
)
def vocabulary_rename(spark: SparkSession, folder: str) -> DataFrame:
    """Renames fire only where the new name is free, and edges follow them."""
    customers = table(spark, folder, "customer")
    renames = {"BUILDING": "CONSTRUCTION", "MACHINERY": "FURNITURE"}
    names = customers.select(F.col("c_mktsegment").alias("name")).distinct()
    blank = F.lit(None).cast("string")
    roles = names.withColumns({"deprecated_name": blank, "spec_source": blank})
    renamed = rename_roles(roles, renames).drop("spec_source")
    edges = rename_keys(customers, "c_mktsegment", {"BUILDING": "CONSTRUCTION"})
    holders = edges.groupBy(F.col("c_mktsegment").alias("name")).agg(
        F.count(F.lit(1)).alias("holders")
    )
    return renamed.join(holders, "name")


@query(
    """
    SELECT user_id, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS first_event,
           arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_type,
           arg_max(event_id, struct_pack(t := ts, e := event_id))
             FILTER (WHERE event_type = 'purchase') AS last_purchase
    FROM events GROUP BY user_id
    """
)
def stream_upsert_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one file merged in one micro-batch."""
    schema = table(spark, folder, "events").schema
    return _merged_events(spark, file_stream(spark, folder, schema, "events.parquet"))


@query(SQL["stream_upsert_events"])
def stream_late_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events in four files merged one after the other, each of them late and one delivered twice."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrived = StagedFolder(spark, "late-events")
    for part in (2, 0, 3, 1, 0):
        rows = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).coalesce(1)
        rows.write.mode("append").parquet(f"{arrived.root}/in")
    stream = file_stream(spark, f"{arrived.root}/in", events.schema, max_files=1)
    return _merged_events(spark, in_time(stream, "ts", "3650 days", ["event_id"]), {"user": 8})


def _merged_events(spark: SparkSession, stream: DataFrame, buckets: dict[str, int] | None = None) -> DataFrame:
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    tables = TableSet(spark, f"{root}/tables", buckets)

    def prepare(batch: DataFrame) -> DataFrame:
        return batch.select(
            "user_id",
            F.col("event_id").alias("first_event"),
            F.col("event_type").alias("last_type"),
            F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("last_purchase"),
            F.struct("ts", "event_id").alias("_seq"),
        )

    merge = Merge(("user_id",), ("first_event",), ("last_type",), ("last_purchase",))
    running = merge_stream(
        stream, tables, "user", merge, f"{root}/checkpoint", prepare=prepare
    )
    running.awaitTermination()
    return without_order(tables.read("user"), merge)


_ORDER_LINES = Load(
    RowSpec(
        "order_lines",
        (
            Field("order_key", kind="integer", required=True),
            Field("line", kind="integer", required=True),
            Field("ship_day"),
        ),
    ),
    (Write("order_line", {"order_key": "order_key", "line": "line"}, set_columns={"ship_day": "ship_day"}),),
    parents=(("order_header", {"order_key": "order_key"}),),
)


@query(
    """
    SELECT DISTINCT 'accepted' AS outcome, l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_linenumber <> 7 AND o_orderstatus <> 'P'
    UNION ALL
    SELECT 'unmatched', l_orderkey, l_linenumber
    FROM lineitem
    WHERE l_linenumber <> 7
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
    UNION ALL
    SELECT 'rejected', l_orderkey, 0 FROM lineitem WHERE l_linenumber = 7
    """
)
def load_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A load of all order lines: the last of an order is rejected, pending orders are unknown.

    Lines arrive in order of their ship day, which many of them share.
    """
    tables = TableSet(spark, StagedFolder(spark, "load-outcomes").root)
    orders = table(spark, folder, "orders").filter("o_orderstatus <> 'P'")
    tables.write("order_header", orders.select(F.col("o_orderkey").alias("order_key")))
    line = F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(F.col("l_linenumber").cast("string"))
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_key"),
        line.alias("line"),
        F.col("l_shipdate").cast("date").cast("string").alias("ship_day"),
    )
    clock = RunClock("load-outcomes", "2026-01-05 06:00:00")
    run_load(_ORDER_LINES, with_sequence(rows, order_by="ship_day"), tables, clock)

    def outcome(name: str, key: Column, number: Column) -> list[Column]:
        return [F.lit(name).alias("outcome"), key.cast("bigint").alias("order_key"), number.cast("bigint").alias("line")]

    def part(column: str, name: str) -> Column:
        return F.get_json_object(column, f"$.{name}")

    accepted = tables.read("order_line").select(*outcome("accepted", F.col("order_key"), F.col("line")))
    lost = tables.read("unmatched_row").select(*outcome("unmatched", part("row", "order_key"), part("row", "line")))
    bad = tables.read("rejected_row").select(*outcome("rejected", part("raw", "order_key"), F.lit(0)))
    return accepted.unionByName(lost).unionByName(bad)


_SUPPLIED = Load(
    RowSpec("supplied_parts", (Field("part", kind="integer", required=True), Field("supplier", kind="integer", required=True))),
    (
        Write("supplied_part", {"part": "part"}),
        Write(
            "supplied_by", {"part": "part", "supplier": "supplier"},
            parents=(("known_supplier", {"supplier": "supplier"}),),
        ),
    ),
)


@query(
    """
    WITH known AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    SELECT 'node' AS outcome, l_partkey AS part, CAST(NULL AS BIGINT) AS supplier, count(DISTINCT l_partkey) AS n
    FROM lineitem GROUP BY ALL
    UNION ALL
    SELECT 'edge', l_partkey, l_suppkey, 1 FROM lineitem
    WHERE l_suppkey IN (FROM known) GROUP BY ALL
    UNION ALL
    SELECT 'supplied_by', l_partkey, l_suppkey, count(*) FROM lineitem
    WHERE l_suppkey NOT IN (FROM known) GROUP BY ALL
    """
)
def edge_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A load whose rows may lack the parent of an edge: nodes are loaded all the same, the rows are kept.

    Suppliers in debt are unknown.
    """
    tables = TableSet(spark, StagedFolder(spark, "edge-outcomes").root)
    known = table(spark, folder, "supplier").filter("s_acctbal > 0")
    tables.write("known_supplier", known.select(F.col("s_suppkey").alias("supplier")))
    rows = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").cast("string").alias("supplier")
    )
    run_load(_SUPPLIED, with_sequence(rows), tables, RunClock("edge-outcomes", "2026-01-05 06:00:00"))

    def counted(name: Column, rows: DataFrame, supplier: Column) -> DataFrame:
        named = rows.select(name.alias("outcome"), F.col("part").cast("bigint").alias("part"), supplier.cast("bigint").alias("supplier"))
        return named.groupBy("outcome", "part", "supplier").agg(F.count(F.lit(1)).alias("n"))

    outcomes = counted(F.lit("node"), tables.read("supplied_part"), F.lit(None)).unionByName(
        counted(F.lit("edge"), tables.read("supplied_by"), F.col("supplier"))
    )
    lost = tables.read_or_none("unmatched_row")
    if lost is None:
        return outcomes
    kept = lost.withColumns({name: F.get_json_object("row", f"$.{name}") for name in ("part", "supplier")})
    return outcomes.unionByName(counted(F.col("table"), kept, F.col("supplier")))
