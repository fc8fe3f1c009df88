"""Rows of one load are written as they come: no task sorts its rows only to write them."""

import pytest

from jobweave.operators.upsert import Merge
from jobweave.operators.validate import Field, RowSpec, split_rows_once
from jobweave.sinks.tables import TableSet
from pyspark.sql import functions as F


@pytest.fixture
def plans(spark):
    """The physical plans of what ran since the test began."""

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        listed = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in map(listed.apply, range(listed.size()))}

    before = set(executions())
    return lambda: [plan for number, plan in executions().items() if number not in before]


def test_checked_rows_are_not_sorted(spark, plans):
    frame = spark.range(100).select(F.col("id").cast("string"), F.when(F.col("id") % 3 > 0, "1").alias("n"), F.col("id").alias("_seq"))
    checked = split_rows_once(frame, RowSpec("unsorted", (Field("id", required=True), Field("n", "integer", required=True))))
    assert plans() and not any("Sort (" in plan for plan in plans())
    assert (checked.accepted_count, checked.rejected_count) == (66, 34)
    assert {r.id for r in checked.accepted.collect()} == {str(i) for i in range(100) if i % 3}
    assert {(r._raw.id, r._raw.n) for r in checked.rejected.collect()} == {(str(i), None) for i in range(0, 100, 3)}


def test_rows_of_one_run_are_not_sorted(spark, tmp_path, plans):
    tables = TableSet(spark, str(tmp_path))
    seen = Merge(("id", "run_id"), (), ("tag",))
    for tag in (1, 2):
        rows = spark.range(20).select("id", F.lit("r").alias("run_id"), F.lit(tag).alias("tag"), F.col("id").alias("_seq"))
        tables.merge("seen", rows, seen)
    writes = [plan for plan in plans() if "InsertIntoHadoopFs" in plan and "Join" not in plan]
    assert writes and not any("Sort (" in plan for plan in writes)
    assert {(r.id, r.tag) for r in tables.read("seen").collect()} == {(i, 2) for i in range(20)}
