"""Derived-view queries: teams, disagreements, channels, runs, pairs, run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import extras
from jobweave.operators.upsert import require_parents
from jobweave.queries.registry import SQL, query, table
from jobweave.sources.files import StagedFolder, child_names
from jobweave.streaming.micro_batch import file_stream
from jobweave.streaming.pairs import append_pairs, pair_stream


@query(
    """
    WITH RECURSIVE manages AS (
      SELECT p_partkey // 3 AS m, p_partkey AS e FROM part WHERE p_partkey > 0),
    walk AS (
      SELECT m, e, 1 AS h FROM manages
      UNION ALL SELECT w.m, g.e, w.h + 1 FROM walk w JOIN manages g ON g.m = w.e WHERE w.h < 6),
    reports AS (SELECT DISTINCT m, e FROM walk)
    SELECT s_suppkey AS seal_id, m AS manager_id, p_brand AS group_name, count(DISTINCT e) AS team_size
    FROM supplier JOIN reports ON m = s_suppkey JOIN part ON p_partkey = e GROUP BY ALL
    """
)
def manager_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Team size per group through one to six levels of management."""
    parts = table(spark, folder, "part")
    manages = parts.filter(F.col("p_partkey") > 0).select(
        F.floor(F.col("p_partkey") / 3).alias("manager_id"),
        F.col("p_partkey").alias("employee_id"),
    )
    groups = parts.select(
        F.col("p_partkey").alias("employee_id"), F.col("p_brand").alias("group_name")
    )
    applications = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("seal_id"), F.col("s_suppkey").alias("manager_id")
    )
    return extras.support_teams(applications, manages, groups).select(
        "seal_id", "manager_id", "group_name", "team_size"
    )


@query(
    """
    SELECT 'no holder' AS issue, p_partkey FROM part
    WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'
                            AND l_linenumber = 1)
    UNION ALL
    SELECT 'holder unknown to second source', l_partkey FROM (
      SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'
      EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
    UNION ALL
    SELECT 'differs from every child', p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey
    GROUP BY p_partkey, p_size HAVING bool_and(p_size <> l_linenumber)
    UNION ALL
    SELECT 'absent from second source', p_partkey FROM part
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = p_size)
    """
)
def recon_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Four kinds of disagreement between two sources."""
    parts = table(spark, folder, "part")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    roles = lines.withColumn("role_name", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    returned = lines.filter(F.col("l_returnflag") == "R")
    accepted = lines.filter(F.col("l_returnflag") != "R")
    return extras.reconciliation_issues(
        {
            "no holder": extras.missing_role(parts, roles, "p_partkey", "N1"),
            "holder unknown to second source": extras.holder_not_among(
                returned, accepted, "p_partkey", "l_suppkey"
            ),
            "differs from every child": extras.differs_from_all(
                parts.select("p_partkey", "p_size"), lines, "p_partkey", "p_size", "l_linenumber"
            ),
            "absent from second source": require_parents(
                parts, lines, {"p_partkey": "p_partkey", "p_size": "l_quantity"}
            )[1],
        },
        "p_partkey",
    )


@query(
    """
    WITH requires AS (
      SELECT DISTINCT l_partkey AS job, l_suppkey || ':' || CAST(l_shipdate AS DATE) AS c
      FROM lineitem WHERE l_returnflag = 'R'),
    emits AS (
      SELECT DISTINCT l_partkey AS job, l_suppkey || ':' || CAST(l_shipdate AS DATE) AS c
      FROM lineitem WHERE l_returnflag <> 'R'),
    marked AS (
      SELECT r.job, bool_or(EXISTS (SELECT 1 FROM emits e WHERE e.c = r.c AND e.job <> r.job))
             AS upstream
      FROM requires r GROUP BY r.job)
    SELECT p_partkey AS job,
           CASE WHEN upstream IS NULL THEN 'TimeChannel' WHEN upstream THEN 'UpstreamJobChannel'
                WHEN p_type = 'ECONOMY' THEN 'SftpChannel' ELSE 'UploadChannel' END AS channel
    FROM part LEFT JOIN marked ON job = p_partkey
    """
)
def attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Which channel each job's work arrives through."""
    lines = table(spark, folder, "lineitem")
    day = F.col("l_shipdate").cast("date").cast("string")
    condition = F.concat_ws(":", F.col("l_suppkey").cast("string"), day)
    link = [F.col("l_partkey").alias("job"), condition.alias("condition")]
    requires = lines.filter(F.col("l_returnflag") == "R").select(*link)
    emits = lines.filter(F.col("l_returnflag") != "R").select(*link)
    jobs = table(spark, folder, "part").select(F.col("p_partkey").alias("job"), "p_type")
    inferred = F.when(F.col("p_type") == "ECONOMY", F.lit("SftpChannel")).otherwise(
        F.lit("UploadChannel")
    )
    return extras.attribute_channels(jobs, requires, emits, ["job"], inferred).select("job", "channel")


@query(
    """
    WITH runs AS (
      SELECT user_id AS job, CAST(ts AS DATE) AS day, event_id, ts, event_type,
             CAST(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60
                  + floor(extract('second' FROM ts)) AS BIGINT) AS s,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
      FROM events),
    daily AS (
      SELECT job, day, count(*) AS n, sum(s) AS s, sum(s + k) AS e, sum(k) AS d,
             arg_max(struct_pack(s := s, e := s + k, t := event_type),
                     struct_pack(t := ts, e := event_id)) AS last
      FROM runs GROUP BY ALL)
    SELECT job, CAST(day AS VARCHAR) AS day, CAST(sum(n) OVER w AS BIGINT) AS runs,
           CAST(sum(s) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS avg_start_second,
           CAST(sum(e) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS avg_end_second,
           CAST(sum(d) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS avg_duration_second,
           last.s AS last_start_second, last.e AS last_end_second, last.t AS last_status
    FROM daily
    WINDOW w AS (PARTITION BY job ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING
                 AND CURRENT ROW)
    """
)
def run_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling seven-day run averages and the last run, per job and day."""
    start = (
        F.hour("ts") * F.lit(3600) + F.minute("ts") * F.lit(60) + F.second("ts")
    ).cast("bigint")
    runs = table(spark, folder, "events").select(
        F.col("user_id").alias("job"), F.col("ts").cast("date").alias("day"), "event_id", "ts",
        "event_type", start.alias("start"),
        (start + F.get_json_object("props", "$.k").cast("bigint")).alias("end"),
    )
    rolled = extras.run_rollup(
        runs, ["job"], "day", "start", "end", "event_type", ["ts", "event_id"]
    )
    return rolled.withColumn("day", F.col("day").cast("string"))


@query(
    """
    WITH files AS (
      SELECT l_suppkey AS dataset, CAST(date_trunc('month', l_shipdate) AS DATE) AS day,
             CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'R' END AS half, count(*) AS n,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
             min(l_quantity) AS low, max(l_quantity) AS high,
             CAST(max(l_shipdate) AS DATE) AS arrived
      FROM lineitem GROUP BY ALL),
    d AS (SELECT * FROM files WHERE half = 'A'), c AS (SELECT * FROM files WHERE half = 'R'),
    j AS (
      SELECT coalesce(d.dataset, c.dataset) AS dataset, coalesce(d.day, c.day) AS day,
             CASE WHEN d.n IS NOT NULL AND c.n IS NOT NULL THEN 'paired'
                  WHEN d.n IS NOT NULL THEN 'control missing' ELSE 'data missing' END AS pair,
             coalesce(abs(d.n - c.n) <= 2, FALSE) AS rowcount_match,
             coalesce(abs(d.cents - c.cents) < 5000000, FALSE) AS hash_match,
             c.n IS NOT NULL AND coalesce(d.low >= 1 AND d.high <= 45, FALSE) AS value_range,
             coalesce(d.arrived <= c.arrived + 10, FALSE) AS freshness_sla
      FROM d FULL JOIN c ON d.dataset = c.dataset AND d.day = c.day)
    SELECT dataset, CAST(day AS VARCHAR) AS day, pair, rowcount_match, hash_match, value_range,
           freshness_sla, rowcount_match AND hash_match AND value_range AND freshness_sla
             AS certified
    FROM j
    """
)
def pair_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Data files checked against their control files, per dataset and business month."""
    data, control = _files(spark, folder)
    checked = extras.pair_checks(data, control, ["dataset", "day"], _file_checks())
    return checked.withColumn("day", F.col("day").cast("string"))


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The data and control files of every dataset and month."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("dataset"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("day"),
        (F.col("l_returnflag") == "A").alias("is_data"), "l_quantity",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_shipdate").cast("date").alias("arrived"),
    )

    def files(half: Column) -> DataFrame:
        return lines.filter(half).groupBy("dataset", "day").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("cents").alias("cents"),
            F.min("l_quantity").alias("low"),
            F.max("l_quantity").alias("high"),
            F.max("arrived").alias("arrived"),
        )

    return files(F.col("is_data")), files(~F.col("is_data"))


def _file_checks() -> dict[str, Column]:
    c = F.col
    return {
        "rowcount_match": F.abs(c("data_n") - c("control_n")) <= 2,
        "hash_match": F.abs(c("data_cents") - c("control_cents")) < 5000000,
        "value_range": (c("data_low") >= 1) & (c("data_high") <= 45),
        "freshness_sla": c("data_arrived") <= F.date_add("control_arrived", 10),
    }


@query(SQL["pair_checks"])
def pair_checks_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs from two streams of files that arrive year by year.

    A month without its half is released when the watermark has passed it; a
    last file far ahead lets time pass for the months at the end. A batch takes
    the files of a year at least, so larger tables make larger batches, not more.
    """
    arrived = StagedFolder(spark, "pairs")
    per_batch = 4
    for name, files in zip(("data", "control"), _files(spark, folder)):
        stamped = files.withColumn("day", F.col("day").cast("timestamp"))
        stamped, _ = arrived.write(stamped, f"{name}-files")
        end = stamped.agg(F.lit(None).cast("bigint").alias("dataset"), (F.max("day") + F.expr("INTERVAL 3000 DAYS")).alias("day"))
        years = [r.year for r in stamped.select(F.year("day").alias("year")).distinct().orderBy("year").collect()]
        before = 0
        for year in years:
            stamped.filter(F.year("day") == year).write.mode("append").parquet(f"{arrived.root}/{name}")
            files_now = sum(child.endswith(".parquet") for child in child_names(spark, f"{arrived.root}/{name}"))
            per_batch, before = max(per_batch, files_now - before), files_now
        last = stamped.filter("false").unionByName(end, allowMissingColumns=True)
        last.coalesce(1).write.mode("append").parquet(f"{arrived.root}/{name}")
    schema = stamped.schema
    data, control = (file_stream(spark, f"{arrived.root}/{name}", schema, max_files=per_batch) for name in ("data", "control"))
    pairs = pair_stream(data, control, ["dataset", "day"], "day", "800 days", _file_checks())
    append_pairs(pairs, f"{arrived.root}/pairs", f"{arrived.root}/checkpoint").awaitTermination()
    released = spark.read.schema(pairs.schema).parquet(f"{arrived.root}/pairs").filter("dataset IS NOT NULL")
    return released.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    """
    WITH items AS (
      SELECT 'USED' AS edge, 'athena' AS namespace, 'part_' || l_partkey AS name, l_partkey AS p
      FROM lineitem
      UNION ALL
      SELECT 'WAS_GENERATED_BY', CASE WHEN l_returnflag = 'R' THEN 'other' ELSE 'athena' END,
             'part_' || (l_partkey + 1), l_partkey + 1
      FROM lineitem)
    SELECT edge, namespace,
           namespace = 'athena' AND p IN (SELECT p_partkey FROM part) AS matched,
           count(*) AS "rows"
    FROM items GROUP BY ALL
    """
)
def run_event_links(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs and outputs of JSON run events matched to known datasets."""
    def dataset(namespace: object, part: object) -> object:
        return F.array(
            F.struct(namespace.alias("namespace"), F.concat(F.lit("part_"), part).alias("name"))
        )

    other = F.when(F.col("l_returnflag") == "R", F.lit("other")).otherwise(F.lit("athena"))
    payload = F.to_json(
        F.struct(
            F.struct(F.col("l_orderkey").cast("string").alias("runId")).alias("run"),
            dataset(F.lit("athena"), F.col("l_partkey").cast("string")).alias("inputs"),
            dataset(other, (F.col("l_partkey") + 1).cast("string")).alias("outputs"),
        )
    )
    events = table(spark, folder, "lineitem").select(payload.alias("event"))
    datasets = table(spark, folder, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name")
    )
    matched = extras.reconcile_run_events(events, "event", datasets, "athena")
    return matched.groupBy("edge", "namespace", "matched").agg(F.count(F.lit(1)).alias("rows"))
