"""Closure queries: jobs are rows of a driver table, conditions link them.

Job ``k`` emits condition ``C<k>`` and requires conditions computed from ``k``.
Names are zero-padded, so the substring guard compares whole names, except
where a query is about names inside one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import closure
from jobweave.queries.registry import query, table


def condition_graph(
    rows: DataFrame, key: str, folder: Column, requires: list[Column], digits: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(consumes, produces) of a graph over one table; names have ``digits`` digits at least."""
    k = F.col(key).cast("bigint")
    number = k.cast("string")
    padded = F.lpad(number, digits, "0") if digits else number
    jobs = rows.select(
        folder.alias("folder"),
        F.concat(F.lit("F"), folder).alias("folder_id"),
        F.concat(F.lit("JOB_"), padded).alias("job"),
        k.cast("string").alias("job_id"),
        F.lit(None).cast("string").alias("cyclic_type"),
        F.lit(1).cast("bigint").alias("version_serial"),
        F.concat(F.lit("C"), k.cast("string")).alias("_emits"),
        F.array_distinct(F.array(*requires)).alias("_requires"),
    )
    kept = [c for c in closure.LINK_COLUMNS if c != "condition"]
    produces = jobs.select(F.col("_emits").alias("condition"), *kept)
    consumes = jobs.select(F.explode("_requires").alias("_k"), *kept).select(
        F.concat(F.lit("C"), F.col("_k").cast("string")).alias("condition"), *kept
    )
    return consumes, produces


def _half(column: str) -> Column:
    return F.floor(F.col(column) / 2)


def _third(column: str) -> Column:
    return F.floor(F.col(column) / 3)


def _graph_sql(source: str, key: str, folder: str, requires: str, digits: int = 10) -> str:
    number = f"CAST({key} AS VARCHAR)"
    padded = f"lpad({number}, {digits}, '0')" if digits else number
    return f"""
    job AS (
      SELECT {folder} AS folder, 'F' || {folder} AS folder_id,
             'JOB_' || {padded} AS job,
             CAST({key} AS VARCHAR) AS job_id, {key} AS k
      FROM {source}),
    need AS (
      SELECT DISTINCT folder, folder_id, job, job_id, unnest([{requires}]) AS c FROM job),
    hop AS (
      SELECT n.folder AS f, n.folder_id AS fi, n.job AS j, n.job_id AS ji,
             'C' || CAST(n.c AS VARCHAR) AS cond,
             p.folder AS pf, p.job AS pj, p.folder_id AS pfi, p.job_id AS pji
      FROM need n JOIN job p ON n.c = p.k AND n.job <> p.job)"""


def _walk_sql(graph: str, anchor: str = "TRUE") -> str:
    return f"""
    WITH RECURSIVE {graph},
    walk AS (
      SELECT f, fi, j, ji, cond, pf, pj, pfi, pji, 1 AS lvl, j || ' -> ' || pj AS path
      FROM hop WHERE {anchor}
      UNION ALL
      SELECT w.f, w.fi, w.j, w.ji, h.cond, h.pf, h.pj, h.pfi, h.pji, w.lvl + 1,
             w.path || ' -> ' || h.pj
      FROM walk w JOIN hop h ON h.j = w.pj
      WHERE w.lvl < 10 AND instr(w.path, h.pj) = 0)"""


_PATHS_SQL = """
    SELECT f AS in_parent_table, j AS in_job_name, fi AS in_parent_table_id, ji AS in_job_id,
           fi || '.' || ji AS in_table_job_id, cond AS out_condition, pf AS dependent_table,
           pj AS dependent_job, pfi AS dependent_table_id, pji AS dependent_job_id,
           pfi || '.' || pji AS out_table_job_id, CAST(lvl AS INTEGER) AS recursion_level,
           path AS dependency_path
    FROM walk"""

_EDGES_SQL = """
    SELECT fi AS in_parent_table_id, ji AS in_job_id, pfi AS dependent_table_id,
           pji AS dependent_job_id, cond AS out_condition,
           CAST(min(lvl) AS INTEGER) AS recursion_level,
           arg_min(path, struct_pack(lvl := lvl, path := path)) AS dependency_path
    FROM walk GROUP BY ALL"""

# A graph with two-cycles (each job and its partner) on suppliers, and two
# acyclic ones on parts.
_PARTNER = _graph_sql("supplier", "s_suppkey", "'S' || CAST(s_nationkey AS VARCHAR)",
                      "k // 2, xor(k, 1)")
_DIAMOND = _graph_sql("part", "p_partkey", "p_brand", "k // 2, k // 3")
_TREE = _graph_sql("part", "p_partkey", "p_brand", "k // 2")
# Over all parts: pairs that need each other, and names such as JOB_1 in JOB_12.
_PAIRED = _graph_sql("part", "p_partkey", "p_brand", "k // 2, xor(k, 1)")
_NESTED = _graph_sql("part", "p_partkey", "p_brand", "k // 2", digits=0)


def _partner_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))
    partner = F.col("s_suppkey").bitwiseXOR(F.lit(1).cast("bigint"))
    return condition_graph(
        table(spark, folder, "supplier"), "s_suppkey", name, [_half("s_suppkey"), partner]
    )


def _part_graph(
    spark: SparkSession, folder: str, *requires: Column, digits: int = 10
) -> tuple[DataFrame, DataFrame]:
    return condition_graph(
        table(spark, folder, "part"), "p_partkey", F.col("p_brand"), list(requires), digits
    )


@query(_walk_sql(_PARTNER) + _PATHS_SQL)
def closure_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every guarded path of a graph with cycles."""
    return closure.dependency_paths(*_partner_graph(spark, folder))


@query(_walk_sql(_PARTNER) + _EDGES_SQL)
def closure_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest edge per pair and condition where the cycle guard fires."""
    return closure.dependency_edges(*_partner_graph(spark, folder))


@query(_walk_sql(_DIAMOND) + _EDGES_SQL)
def closure_edges_acyclic(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest edges of a graph with many parallel paths, breadth first."""
    requires = (_half("p_partkey"), _third("p_partkey"))
    return closure.dependency_edges(*_part_graph(spark, folder, *requires))


@query(_walk_sql(_PAIRED) + _EDGES_SQL)
def closure_edges_cyclic(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest edges over all parts where each part and its partner need each other."""
    partner = F.col("p_partkey").cast("bigint").bitwiseXOR(F.lit(1).cast("bigint"))
    return closure.dependency_edges(*_part_graph(spark, folder, _half("p_partkey"), partner))


@query(_walk_sql(_DIAMOND, "f LIKE 'Brand#1%'") + _EDGES_SQL)
def closure_edges_anchored(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest edges that start in folders matching a pattern."""
    requires = (_half("p_partkey"), _third("p_partkey"))
    graph = _part_graph(spark, folder, *requires)
    return closure.dependency_edges(*graph, anchor_like="Brand#1%")


@query(_walk_sql(_NESTED) + _EDGES_SQL)
def closure_edges_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest edges where the substring guard stops at names inside one another."""
    graph = _part_graph(spark, folder, _half("p_partkey"), digits=0)
    return closure.dependency_edges(*graph)


@query(_walk_sql(_TREE) + _PATHS_SQL)
def closure_tree_scale(spark: SparkSession, folder: str) -> DataFrame:
    """N log N paths of a tree over all parts."""
    return closure.dependency_paths(*_part_graph(spark, folder, _half("p_partkey")))


@query(_walk_sql(_TREE) + _EDGES_SQL)
def closure_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Path rows collapsed to the first per edge, independent of row order."""
    paths = closure.dependency_paths(*_part_graph(spark, folder, _half("p_partkey")))
    return closure.shortest_edges(paths)


@query(_walk_sql(_TREE, "f LIKE 'Brand#1%'") + _PATHS_SQL)
def closure_anchored(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that start in folders matching a pattern and cross into any folder."""
    graph = _part_graph(spark, folder, _half("p_partkey"))
    return closure.dependency_paths(*graph, anchor_like="Brand#1%")


@query(
    """
    SELECT DISTINCT 'P' || CAST(l_partkey AS VARCHAR) AS condition, c_name AS folder,
           CAST(o_custkey AS VARCHAR) AS folder_id, o_orderpriority AS job,
           CAST(o_orderkey AS VARCHAR) AS job_id, o_orderstatus AS cyclic_type,
           CAST(l_linenumber AS BIGINT) AS version_serial
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE c_acctbal > 0 AND l_linenumber = CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
      AND l_returnflag = 'R'
    """
)
def job_condition_links(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs of active folders matched to condition links on (folder, job, version)."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    folders = customers.select(
        F.col("c_custkey").cast("string").alias("folder_id"),
        F.when(F.col("c_acctbal") > 0, F.lit("Y")).otherwise(F.lit(" ")).alias("user_daily"),
    )
    names = customers.select("c_custkey", "c_name")
    jobs = orders.join(names, orders.o_custkey == names.c_custkey).select(
        F.col("o_custkey").cast("string").alias("folder_id"),
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("version_serial"),
        F.col("c_name").alias("parent_table"),
        F.col("o_orderpriority").alias("job_name"),
        F.col("o_orderstatus").alias("cyclic_type"),
    )
    owner = orders.select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem")
    links = lines.join(owner, lines.l_orderkey == owner.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("folder_id"),
        F.col("l_orderkey").cast("string").alias("job_id"),
        F.col("l_linenumber").cast("bigint").alias("version_serial"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("condition_name"),
        F.when(F.col("l_returnflag") == "R", F.lit("+")).otherwise(F.lit("-")).alias("sign"),
    )
    return closure.job_links(jobs, folders, links, only_posting=True)
