"""Shapes of physical plans that matter at scale."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobweave.operators import closure, history, quality
from jobweave.sources.readers import Source
from jobweave.sources.specs import current_rows, project_view

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_projection_and_filter_reach_the_scan(spark, tmp_path):
    wide = spark.range(5).select(
        *[F.col("id").cast("string").alias(c) for c in ("table_id", "job_id", "job_name")],
        F.lit("1").alias("is_current_version"),
        F.lit("1").alias("version_serial"),
        *[F.lit("x").alias(f"unused_{i}") for i in range(70)],
    )
    wide.write.parquet(str(tmp_path / "jobs"))
    source = Source("parquet", str(tmp_path / "jobs"))
    rows = source.read(spark, lambda df: current_rows(project_view(df, "controlm_jobs")))
    plan = plan_of(rows)
    assert "unused_" not in plan
    assert "EqualTo(is_current_version,1)" in plan


def test_retention_keeps_recent_rows_without_a_shuffle(spark, tmp_path):
    columns = "snapshot_id string, entity_key string, hash string, state_json string, " \
              "valid_from date, valid_to date, created_at timestamp"
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "h"))
    import datetime

    plan = plan_of(history.prune_versions(spark.read.parquet(str(tmp_path / "h")), datetime.date(2025, 1, 1)))
    assert "GreaterThanOrEqual(valid_from,2020-01-03)" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Window" not in plan


def test_shortest_edges_combine_before_the_shuffle(spark):
    schema = ", ".join(f"{c} string" for c in closure.EDGE_KEYS)
    rows = spark.createDataFrame([], schema + ", recursion_level int, dependency_path string")
    assert "partial_min" in plan_of(closure.shortest_edges(rows))


def test_duplicate_check_reads_only_its_key(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    plan = plan_of(quality.no_duplicates(lines, ["l_orderkey", "l_linenumber"], "d"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
