"""Integrity-check queries over the driver tables."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import quality
from jobweave.operators.upsert import fixed_children
from jobweave.queries.registry import query, table
from jobweave.sinks.key_counts import KeyCounts
from jobweave.sinks.tables import TableSet
from jobweave.sinks.together import run_together
from jobweave.sources.files import StagedFolder, stage
from jobweave.sources.readers import literal_table
from jobweave.sources.vocabulary import provenance_matrix

_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
}


def _key_sql(name: str, keys: list[str]) -> str:
    nulls = " OR ".join(f"{k} IS NULL" for k in keys)
    return f"""
    SELECT '{name}' AS "check",
           (SELECT count(*) FROM {name} WHERE {nulls}) AS null_keys,
           (SELECT count(*) FROM (SELECT {", ".join(keys)} FROM {name} WHERE NOT ({nulls})
             GROUP BY ALL HAVING count(*) > 1)) AS duplicate_keys"""


@query(" UNION ALL ".join(_key_sql(n, k) for n, k in _KEYS.items()))
def key_checks(spark: SparkSession, folder: str) -> DataFrame:
    """NULL and duplicate keys of eight tables."""
    return quality.report(
        [quality.key_report(table(spark, folder, n), k, n) for n, k in _KEYS.items()]
    )


#: Keys that hold and keys that do not, with a condition that parts their rows into the runs of a load.
_LOADED_KEYS = {
    "lines": ("lineitem", ["l_orderkey", "l_linenumber"], "l_returnflag = 'R'"),
    "lines_of_part": ("lineitem", ["l_partkey", "l_suppkey"], "l_linestatus = 'F'"),
    "orders_of_day": ("orders", ["o_custkey", "o_orderdate"], "o_orderstatus = 'O'"),
    "events_of_user": ("events", ["user_id", "event_type"], "value > 50"),
}


@query(
    " UNION ALL ".join(
        _key_sql(t, keys).replace(f"'{t}' AS", f"'{name}' AS") for name, (t, keys, _) in _LOADED_KEYS.items()
    )
)
def key_checks_by_run(spark: SparkSession, folder: str) -> DataFrame:
    """NULL and duplicate keys from counts stored by run; the first run of each table is added twice.

    A row for which the condition is NULL is in the run of those that do not meet it.
    """
    tables = TableSet(spark, StagedFolder(spark, "key-counts").root)
    reports = {}

    def load(name: str) -> None:
        source, keys, first = _LOADED_KEYS[name]
        run = F.when(F.expr(first), "run-1").otherwise("run-2")
        rows = table(spark, folder, source).withColumn("run", run)
        counts = KeyCounts(tables, name, keys)
        for run_id in ("run-1", "run-2", "run-1"):
            counts.add(rows.filter(F.col("run") == run_id), run_id)
        reports[name] = counts.report(rows, name, "run")

    run_together(spark, [partial(load, name) for name in _LOADED_KEYS])
    return quality.report([reports[name] for name in _LOADED_KEYS])


@query(
    """
    WITH n AS (
      SELECT n_nationkey, n_regionkey, count(c_custkey) AS customers
      FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT r_name, count(n_nationkey) AS nations,
           CAST(coalesce(sum(customers), 0) AS BIGINT) AS customers,
           count(*) FILTER (WHERE customers = 0) AS empty_nations
    FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY r_name
    """
)
def hierarchy_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Containment hops with a count per group, then rolled up."""
    per_nation = (
        table(spark, folder, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    nations = table(spark, folder, "nation").join(per_nation, "n_nationkey", "left").select(
        F.col("n_regionkey").alias("r_regionkey"),
        "n_nationkey",
        F.coalesce("customers", F.lit(0)).alias("customers"),
    )
    return (
        table(spark, folder, "region")
        .join(nations, "r_regionkey", "left")
        .groupBy("r_name")
        .agg(
            F.count("n_nationkey").alias("nations"),
            F.coalesce(F.sum("customers"), F.lit(0)).alias("customers"),
            F.count_if(F.col("customers") == 0).alias("empty_nations"),
        )
    )


def _driver_checks(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    customers, parts = table(spark, folder, "customer"), table(spark, folder, "part")
    returned = lines.filter(F.col("l_returnflag") == "R")
    accepted = lines.filter(F.col("l_returnflag") != "R")
    terms = parts.select(F.col("p_name").alias("iri"), F.lit("LocalClass").alias("source_label"))
    derived = orders.select(
        (F.col("o_orderstatus") != "F").alias("derived"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("recursion_level"),
        F.col("o_orderpriority").alias("dependency_path"),
    )
    applications = customers.select(F.col("c_custkey").alias("seal_id"))
    ports = fixed_children(
        customers.select(
            F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))
            .otherwise(-F.col("c_custkey"))
            .alias("parent_seal_id")
        ),
        ("EventProcessing", "BatchProcessing"),
    )
    return quality.report(
        [
            quality.every_row_linked(
                orders.withColumnRenamed("o_custkey", "c_custkey"), customers, ["c_custkey"],
                "every order has a customer",
            ),
            quality.every_row_linked(
                orders.withColumnRenamed("o_orderkey", "k"),
                lines.select(F.col("l_orderkey").alias("k")).distinct(), ["k"],
                "every order has a line",
            ),
            quality.no_duplicates(lines, ["l_orderkey", "l_linenumber"], "no duplicate line"),
            quality.no_duplicates(orders, ["o_orderkey"], "no duplicate order"),
            quality.present_once(
                table(spark, folder, "region").filter(F.col("r_name") == "ASIA"), "one ASIA"
            ),
            quality.local_terms_seeded(
                terms, "red terms", "red ", ("widget", "bolt", "ring"), at_least=3
            ),
            quality.no_empty_parents(
                customers.select("c_custkey"),
                orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"],
                "customers have orders",
            ),
            quality.no_orphans(
                parts.select(F.col("p_partkey").alias("l_partkey")), [returned, accepted],
                ["l_partkey"], "no orphan parts",
            ),
            quality.edges_complete(derived, "edges complete"),
            quality.both_ports(applications, ports, "both ports"),
        ]
    )


_CHECKS_SQL = """
    WITH checks AS (
    SELECT 'every order has a customer' AS "check", count(*) = count(c_custkey) AS ok,
           'rows=' || count(*) || ' linked=' || count(c_custkey) AS detail
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    UNION ALL
    SELECT 'every order has a line', count(*) = count(l_orderkey),
           'rows=' || count(*) || ' linked=' || count(l_orderkey)
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey
    UNION ALL
    SELECT 'no duplicate line', count(*) = 0, 'dupes=' || count(*)
    FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
    UNION ALL
    SELECT 'no duplicate order', count(*) = 0, 'dupes=' || count(*)
    FROM (SELECT o_orderkey FROM orders GROUP BY ALL HAVING count(*) > 1)
    UNION ALL
    SELECT 'one ASIA', count(*) = 1, 'n=' || count(*) FROM region WHERE r_name = 'ASIA'
    UNION ALL
    SELECT 'red terms', count(DISTINCT p_name) >= 3, 'n=' || count(DISTINCT p_name)
    FROM part WHERE p_name LIKE 'red %'
      AND (p_name LIKE '%widget' OR p_name LIKE '%bolt' OR p_name LIKE '%ring')
    UNION ALL
    SELECT 'customers have orders', count(*) FILTER (WHERE n = 0) = 0,
           'empty=' || count(*) FILTER (WHERE n = 0) || ' total=' || count(*)
    FROM (SELECT c_custkey, count(o_custkey) AS n
          FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
    UNION ALL
    SELECT 'no orphan parts', count(*) FILTER (WHERE k IS NULL) = 0,
           'orphan=' || count(*) FILTER (WHERE k IS NULL) || ' total=' || count(*)
    FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem) ON p_partkey = k
    UNION ALL
    SELECT 'edges complete', count(*) FILTER (WHERE o_orderpriority = '5-LOW') = 0,
           'total=' || count(*) || ' missing_level=' ||
           count(*) FILTER (WHERE o_orderpriority = '5-LOW') || ' missing_path=0'
    FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL
    SELECT 'both ports', count(*) = count(*) FILTER (WHERE c_acctbal > 0),
           'apps=' || count(*) || ' ep=' || count(*) FILTER (WHERE c_acctbal > 0) || ' bp=' ||
           count(*) FILTER (WHERE c_acctbal > 0)
    FROM customer)
"""


@query(_CHECKS_SQL + ' SELECT "check", ok, detail FROM checks')
def verify_report(spark: SparkSession, folder: str) -> DataFrame:
    """Ten integrity checks as (check, ok, detail)."""
    return _driver_checks(spark, folder)


@query(_CHECKS_SQL + " SELECT bool_and(ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed FROM checks")
def verify_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every check passed, and how many failed."""
    return quality.overall(_driver_checks(spark, folder))


@query(
    """
    SELECT event_type AS edge_type, 'User' AS from_node,
           CASE WHEN value > 20 THEN 'Page' ELSE 'Cart' END AS to_node, count(*) AS "rows"
    FROM events
    WHERE NOT (event_type = 'click' AND value > 20) AND NOT (event_type = 'purchase'
          AND value <= 20) AND event_type <> 'view'
    GROUP BY ALL
    """
)
def edge_registry_check(spark: SparkSession, folder: str) -> DataFrame:
    """Edge triples found in the data that no active registry entry declares."""
    registry = literal_table(
        spark,
        [
            ("click", "User", "Page", "active"),
            ("purchase", "User", "Cart", "active"),
            ("view", "*", "*", "active"),
            ("error", "User", "Page", "planned"),
        ],
        "edge_type string, from_node string, to_node string, status string",
    )
    target = F.when(F.col("value") > 20, F.lit("Page")).otherwise(F.lit("Cart"))
    observed = (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("edge_type"), target.alias("to_node"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("from_node", F.lit("User"))
    )
    return quality.edge_registry_gaps(observed, registry).select(
        "edge_type", "from_node", "to_node", "rows"
    )


_ENDS = {
    "orders": ("PLACED_BY", "Order", {"o_orderkey": "o_orderkey"}, "Customer", {"o_custkey": "c_custkey"}),
    "events": ("SAW", "Customer", {"user_id": "c_custkey"}, "Part", {"event_id": "p_partkey"}),
    "lineitem": ("SHIPS", "Supplier", {"l_suppkey": "s_suppkey"}, "Part", {"l_partkey": "p_partkey"}),
}
_BILLED = ("BILLED", "Order", {"l_orderkey": "o_orderkey"}, "Supplier", {"l_suppkey": "s_suppkey"})


@query(
    """
    WITH census AS (
      SELECT 'PLACED_BY' AS edge_type, 'Order' AS from_node,
             CASE WHEN c_custkey IS NOT NULL THEN 'Customer' END AS to_node, count(*) AS edges
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL
      UNION ALL
      SELECT 'SAW', CASE WHEN c_custkey IS NOT NULL THEN 'Customer' END,
             CASE WHEN p_partkey IS NOT NULL THEN 'Part' END, count(*)
      FROM events LEFT JOIN customer ON c_custkey = user_id
                  LEFT JOIN part ON p_partkey = event_id GROUP BY ALL
      UNION ALL
      SELECT 'SHIPS', CASE WHEN s_suppkey IS NOT NULL THEN 'Supplier' END,
             CASE WHEN p_partkey IS NOT NULL THEN 'Part' END, count(*)
      FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey
                    LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL
      UNION ALL
      SELECT 'BILLED', CASE WHEN o_orderkey IS NOT NULL THEN 'Order' END,
             CASE WHEN s_suppkey IS NOT NULL THEN 'Supplier' END, count(*)
      FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
                    LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
    SELECT *, 'stray' AS finding FROM census WHERE from_node IS NULL OR to_node IS NULL
    UNION ALL
    SELECT *, CASE edge_type WHEN 'SHIPS' THEN 'off_matrix' ELSE 'undeclared' END FROM census
    WHERE from_node IS NOT NULL AND to_node IS NOT NULL AND edge_type IN ('SHIPS', 'BILLED')
    """
)
def edge_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of four tables, resolved by key, that end nowhere, are not declared or link wrong kinds.

    Events name parts by their own number, so those beyond the last part end nowhere.
    """
    nodes = {
        "Order": table(spark, folder, "orders"),
        "Customer": table(spark, folder, "customer"),
        "Supplier": table(spark, folder, "supplier"),
        "Part": table(spark, folder, "part"),
    }
    claims = [*_ENDS.items(), ("lineitem", _BILLED)]
    censuses = []
    for name, claim in claims:
        ends = quality.EdgeEnds(*claim)
        rows = table(spark, folder, name)
        censuses.append(quality.edge_census(rows, ends, nodes[ends.from_node], nodes[ends.to_node]))
    registry = literal_table(
        spark,
        [
            ("PLACED_BY", "Order", "Customer", "prov:wasAttributedTo", "active"),
            ("SAW", "*", "Part", None, "active"),
            ("SHIPS", "Supplier", "Part", "prov:used", "active"),
            ("BILLED", "Order", "Supplier", None, "planned"),
        ],
        "edge_type string, from_node string, to_node string, term string, status string",
    )
    kinds = literal_table(
        spark,
        [("Order", "Entity"), ("Customer", "Agent"), ("Supplier", "Agent"), ("Part", "Entity")],
        "label string, kind string",
    )
    census = stage(reduce(DataFrame.unionByName, censuses), "census")
    return quality.edge_findings(census, registry, provenance_matrix(spark), kinds)
