"""Row queries: coercion, validation, decomposition, filters, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import coerce
from jobweave.functions.identifiers import expand_identifier, identifier_error
from jobweave.functions.names import folder_name_columns
from jobweave.functions.roles import canonical_role
from jobweave.operators.quality import label_counts as count_labels
from jobweave.operators.reshape import flag_orphans, splay_list, wide_to_long
from jobweave.operators.upsert import dimension, fixed_children, require_parents
from jobweave.operators.validate import Field, RowSpec, error_counts, split_rows
from jobweave.queries.registry import query, table

_EVENTS = RowSpec(
    "events",
    (
        Field("event_id", "integer", required=True, low=0),
        Field("user_id", "integer", required=True, low=10),
        Field("event_type", required=True, domain=("click", "view", "purchase", "signup")),
        Field("value", "number", high=50.0),
        Field("k", "integer", low=0, high=80),
        Field("day", "day", required=True),
    ),
)


def _raw_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("_seq"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        F.col("value").cast("string").alias("value"),
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_type") == "signup", F.lit("n/a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
    )


_CHECKED_SQL = """
    WITH raw AS (
      SELECT event_id, user_id, event_type, value,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(ts AS DATE) END AS day
      FROM events),
    checked AS (
      SELECT *, list_filter([
          CASE WHEN event_id < 0 THEN 'event_id:range' END,
          CASE WHEN user_id < 10 THEN 'user_id:range' END,
          CASE WHEN event_type NOT IN ('click','view','purchase','signup')
               THEN 'event_type:domain' END,
          CASE WHEN value > 50 THEN 'value:range' END,
          CASE WHEN k < 0 OR k > 80 THEN 'k:range' END,
          CASE WHEN day IS NULL THEN 'day:date' END], lambda x: x IS NOT NULL) AS errors
      FROM raw)
"""


@query(
    _CHECKED_SQL
    + """
    SELECT error, count(*) AS "rows" FROM (
      SELECT unnest(errors) AS error FROM checked
      UNION ALL SELECT 'accepted' FROM checked WHERE len(errors) = 0
      UNION ALL SELECT 'rejected' FROM checked WHERE len(errors) > 0) GROUP BY error
    """
)
def reject_split(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected counts, and rejects per broken rule."""
    checked = split_rows(_raw_events(spark, folder), _EVENTS)
    counts = [
        half.agg(F.lit(name).alias("error"), F.count(F.lit(1)).alias("rows"))
        for name, half in (("accepted", checked.accepted), ("rejected", checked.rejected))
    ]
    return error_counts(checked.rejected).unionByName(counts[0]).unionByName(counts[1])


@query(
    _CHECKED_SQL
    + """SELECT event_id, array_to_string(errors, ',') AS errors FROM checked
         WHERE len(errors) > 0"""
)
def reject_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every rejected row with its errors."""
    rejected = split_rows(_raw_events(spark, folder), _EVENTS).rejected
    return rejected.select(
        F.col("_raw.event_id").cast("bigint").alias("event_id"),
        F.concat_ws(",", "_errors").alias("errors"),
    )


@query(
    _CHECKED_SQL
    + """SELECT event_id, user_id, event_type, value, k, CAST(day AS VARCHAR) AS day
         FROM checked WHERE len(errors) = 0"""
)
def accepted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every accepted row, typed."""
    accepted = split_rows(_raw_events(spark, folder), _EVENTS).accepted
    return accepted.drop("_seq").withColumn("day", F.col("day").cast("string"))


@query(
    """
    WITH raw AS (
      SELECT o_orderkey, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p,
             CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '[Null]' WHEN '5-LOW' THEN 'N/A'
                  ELSE substr(o_orderpriority, 3) END AS note,
             CAST(o_orderdate AS DATE) AS d
      FROM orders)
    SELECT o_orderkey,
           CASE WHEN s = 'F' THEN FALSE END AS status_flag,
           CASE WHEN p = '1' THEN TRUE END AS priority_flag,
           CAST(p AS BIGINT) AS priority,
           CAST(NULL AS BIGINT) AS status_number,
           CASE WHEN note NOT IN ('[Null]', 'N/A') THEN note END AS note,
           CAST(d AS VARCHAR) AS day
    FROM raw
    """
)
def token_coerce(spark: SparkSession, folder: str) -> DataFrame:
    """Flags, integers, NULL tokens and dates read from untidy text."""
    orders = table(spark, folder, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    note = (
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("[Null]"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("N/A"))
        .otherwise(F.expr("substring(o_orderpriority, 3)"))
    )
    untidy = orders.select(
        "o_orderkey",
        F.concat(F.lit(" "), "o_orderstatus", F.lit("\t")).alias("s"),
        F.concat(F.lit("  "), first).alias("p"),
        F.concat(F.lit(" "), note, F.lit(" ")).alias("note"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("d"),
    )
    return untidy.select(
        "o_orderkey",
        coerce.to_flag("s").alias("status_flag"),
        coerce.to_flag("p").alias("priority_flag"),
        coerce.to_integer("p").alias("priority"),
        coerce.to_integer("s").alias("status_number"),
        coerce.tokens_to_null("note").alias("note"),
        coerce.to_day("d").cast("string").alias("day"),
    )


_SPELLING = {
    "AUTOMOBILE": " AO ",
    "BUILDING": "Data Owner",
    "FURNITURE": "bio",
    "HOUSEHOLD": "n/a",
    "MACHINERY": "Somebody Else",
}


@query(
    """
    SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Application Owner'
           WHEN 'BUILDING' THEN 'Primary Information Owner'
           WHEN 'FURNITURE' THEN 'Backup Information Owner' END AS role_name
    FROM customer
    """
)
def canonical_map(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings mapped to canonical names; unknown spellings are NULL."""
    segment = F.col("c_mktsegment")
    spelled = F.create_map(*[F.lit(x) for pair in _SPELLING.items() for x in pair])[segment]
    return table(spark, folder, "customer").select(
        "c_custkey", canonical_role(spelled).alias("role_name")
    )


@query(
    """
    WITH named AS (
      SELECT p_partkey,
             CASE WHEN p_size < 10 THEN p_type
                  ELSE substr(p_type, 1, 1) || substr(p_name, 1, 1) || substr(p_name, 4, 3)
                       || substr(p_type, 2, 1) END
             || CASE WHEN p_size > 45 THEN '' ELSE '-' || p_brand || '-' || p_type END AS n
      FROM part),
    cut AS (
      SELECT p_partkey, n, split_part(n, '-', 1) AS prefix,
             length(split_part(n, '-', 1)) >= 6 AS long
      FROM named),
    letters AS (
      SELECT *, CASE WHEN long THEN upper(substr(prefix, 1, 1)) END AS e,
             CASE WHEN long THEN upper(substr(prefix, 2, 1)) END AS l,
             CASE WHEN long THEN upper(substr(prefix, 3, 3)) END AS a,
             CASE WHEN long THEN upper(substr(prefix, 6, 1)) END AS t
      FROM cut)
    SELECT p_partkey, prefix,
           CASE WHEN e IN ('P','D','Q') THEN e END AS environment_code,
           CASE e WHEN 'P' THEN 'Production' WHEN 'D' THEN 'Development' WHEN 'Q' THEN 'QA' END
             AS environment,
           CASE WHEN l IN ('R','Y','K','B') THEN l END AS lob_code,
           CASE l WHEN 'R' THEN 'Retail' WHEN 'Y' THEN 'Testing3' WHEN 'K' THEN 'Testing2'
                WHEN 'B' THEN 'Testing' END AS lob,
           CASE WHEN regexp_full_match(a, '[A-Z]{3}') THEN a END AS app_code,
           t AS folder_type_code,
           CASE t WHEN 'G' THEN 'Group Table/Smart folder' WHEN 'D' THEN 'Daily'
                WHEN 'W' THEN 'Weekly' WHEN 'M' THEN 'Monthly' WHEN 'Q' THEN 'Quarterly'
                WHEN 'H' THEN 'Holiday' WHEN 'R' THEN 'Request Job/ Ad-hoc' END AS folder_type,
           array_to_string(string_split(n, '-')[2:], '|') AS segments,
           coalesce(e IN ('P','D','Q'), FALSE) AS prefix_recognized
    FROM letters
    """
)
def name_decompose(spark: SparkSession, folder: str) -> DataFrame:
    """Folder-style names taken apart; every branch of the convention occurs."""
    parts = table(spark, folder, "part")
    short = F.col("p_type")
    full = F.concat(
        F.substring("p_type", 1, 1), F.substring("p_name", 1, 1), F.substring("p_name", 4, 3),
        F.substring("p_type", 2, 1),
    )
    tail = F.when(F.col("p_size") > 45, F.lit("")).otherwise(
        F.concat(F.lit("-"), "p_brand", F.lit("-"), "p_type")
    )
    name = F.concat(F.when(F.col("p_size") < 10, short).otherwise(full), tail)
    columns = folder_name_columns(F.col("_name"))
    columns["segments"] = F.concat_ws("|", columns["segments"])
    return parts.select("p_partkey", name.alias("_name")).select(
        "p_partkey", *[c.alias(k) for k, c in columns.items()]
    )


@query(
    """
    WITH named AS (
      SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'dcat:' || p_brand
             WHEN 'PROMO' THEN 'prov:' || p_name WHEN 'MEDIUM' THEN 'nope:' || p_brand
             WHEN 'LARGE' THEN p_brand ELSE 'swo:a:b' END AS n
      FROM part)
    SELECT p_partkey,
           CASE split_part(n, ':', 1) WHEN 'dcat' THEN 'http://www.w3.org/ns/dcat#'
                WHEN 'prov' THEN 'http://www.w3.org/ns/prov#'
                WHEN 'swo' THEN 'http://www.ebi.ac.uk/swo/' END
             || substr(n, instr(n, ':') + 1) AS iri,
           CASE WHEN instr(n, ':') = 0 THEN 'not a compact identifier'
                WHEN split_part(n, ':', 1) = 'nope' THEN 'unknown prefix' END AS error
    FROM named
    """
)
def identifier_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Compact identifiers expanded; the rest with the reason."""
    kind = F.col("p_type")
    named = (
        F.when(kind == "ECONOMY", F.concat(F.lit("dcat:"), "p_brand"))
        .when(kind == "PROMO", F.concat(F.lit("prov:"), "p_name"))
        .when(kind == "MEDIUM", F.concat(F.lit("nope:"), "p_brand"))
        .when(kind == "LARGE", F.col("p_brand"))
        .otherwise(F.lit("swo:a:b"))
    )
    parts = table(spark, folder, "part").select("p_partkey", named.alias("n"))
    return parts.select(
        "p_partkey", expand_identifier("n").alias("iri"), identifier_error("n").alias("error")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
    """
)
def active_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Rows inherit the active filter of their parent."""
    active = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "O")
    return table(spark, folder, "lineitem").join(
        active, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"
    ).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """
    SELECT 'order without line' AS kind, o_orderkey AS id FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL
    SELECT 'customer without order', c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL
    SELECT 'part not ordered at its size', p_partkey FROM part
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = p_size)
    """
)
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Rows a required-parent merge would drop, kept as an output."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    customers, parts = table(spark, folder, "customer"), table(spark, folder, "part")
    cases = [
        ("order without line", orders, lines, {"o_orderkey": "l_orderkey"}),
        ("customer without order", customers, orders, {"c_custkey": "o_custkey"}),
        ("part not ordered at its size", parts, lines, {"p_partkey": "l_partkey", "p_size": "l_quantity"}),
    ]
    found = [
        require_parents(child, parent, keys)[1].select(
            F.lit(kind).alias("kind"), F.col(next(iter(keys))).alias("id")
        )
        for kind, child, parent, keys in cases
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    """
    SELECT DISTINCT l_orderkey AS app_id, role_name, sid,
           CAST(l_orderkey AS VARCHAR) || '|SEAL|' || role_name || '|' || sid AS membership_id
    FROM (
      SELECT l_orderkey, 'Application Owner' AS role_name, CAST(l_partkey AS VARCHAR) AS sid
      FROM lineitem
      UNION ALL SELECT l_orderkey, 'CTO', CAST(l_suppkey AS VARCHAR) FROM lineitem
      UNION ALL SELECT l_orderkey, 'Primary Information Owner',
             CASE WHEN l_returnflag <> 'N' THEN l_returnflag END FROM lineitem)
    WHERE sid IS NOT NULL
    """
)
def wide_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Three contact columns of a wide row as distinct long memberships."""
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    wide = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("app_id"),
        F.col("l_partkey").cast("string").alias("owner"),
        F.col("l_suppkey").cast("string").alias("officer"),
        flag.alias("information"),
    )
    pairs = {
        "Application Owner": ["owner"],
        "CTO": ["officer"],
        "Primary Information Owner": ["information"],
    }
    long = wide_to_long(wide, ["app_id"], pairs, ["sid"], "role_name")
    return (
        long.select("app_id", "role_name", "sid")
        .distinct()
        .withColumn(
            "membership_id",
            F.concat_ws("|", F.col("app_id").cast("string"), F.lit("SEAL"), "role_name", "sid"),
        )
    )


@query(
    """
    SELECT 'server' AS kind, CAST(o_orderpriority AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS port
    FROM (SELECT DISTINCT o_orderpriority FROM orders)
    UNION ALL
    SELECT 'stub', CAST(l_partkey AS VARCHAR), NULL FROM (SELECT DISTINCT l_partkey FROM lineitem)
    UNION ALL
    SELECT 'port', CAST(c_custkey AS VARCHAR), p FROM customer,
           (VALUES ('EventProcessing'), ('BatchProcessing')) v(p)
    """
)
def stub_and_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension rows of a column, stubs of referenced parents, two ports per row."""
    servers = dimension(table(spark, folder, "orders"), "o_orderpriority", "id")
    stubs = dimension(table(spark, folder, "lineitem"), "l_partkey", "id")
    ports = fixed_children(
        table(spark, folder, "customer").select(F.col("c_custkey").alias("id")),
        ("EventProcessing", "BatchProcessing"),
        "port",
    )
    no_port = F.lit(None).cast("string").alias("port")
    rows = [
        servers.select(F.lit("server").alias("kind"), "id", no_port),
        stubs.select(F.lit("stub").alias("kind"), F.col("id").cast("string").alias("id"), no_port),
        ports.select(F.lit("port").alias("kind"), F.col("id").cast("string").alias("id"), "port"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    """
    SELECT w AS source_label, count(*) AS terms
    FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> 'ring' GROUP BY w
    """
)
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per label of a multi-label column, one label left out."""
    return count_labels(table(spark, folder, "part"), F.split("p_name", " "), skip=["ring"])


@query(
    """
    WITH items AS (
      SELECT DISTINCT c_custkey, unnest([CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR),
             CAST(c_custkey + 5 AS VARCHAR)]) AS ref_id
      FROM customer)
    SELECT c_custkey, ref_id,
           ref_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) AS orphan
    FROM items
    """
)
def splay_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A comma-separated id column as rows, unknown ids flagged."""
    listed = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat_ws(
            ", ", F.col("c_custkey").cast("string"), F.lit(""), F.col("c_nationkey").cast("string"),
            (F.col("c_custkey") + 5).cast("string"),
        ).alias("ids"),
    )
    known = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("ref_id"))
    return flag_orphans(splay_list(listed, "ids", "ref_id"), known, "ref_id").select(
        "c_custkey", "ref_id", "orphan"
    )
