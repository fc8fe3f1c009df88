"""Tables dealt into parts: what a merge reads and replaces, and what it leaves alone."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobweave.operators.upsert import Merge, upsert
from jobweave.sinks import tables as sinks
from jobweave.sinks.tables import TableSet

MERGE = Merge(("k",), ("first",), ("last",), ("kept",))


def files(root):
    """{data file: its time of change} below a folder, by the part it is in."""
    found = {}
    for path in Path(root).rglob("*.parquet"):
        found.setdefault(path.parent.name, {})[path.name] = os.stat(path).st_mtime_ns
    return found


def batch(spark, low, high, tag):
    return spark.range(low, high).select(
        F.col("id").alias("k"), F.lit(tag).alias("first"), F.lit(tag).alias("last"),
        F.when(F.col("id") % 2 == 0, F.lit(tag)).alias("kept"), F.col("id").alias("_seq"),
    )


def rows(frame):
    order = sorted(frame.columns)
    return sorted(map(str, (tuple(r[c] for c in order) for r in frame.collect())))


def test_a_merge_of_few_keys_leaves_other_buckets_alone(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path), buckets={"n": 64})
    whole = upsert(None, batch(spark, 0, 5000, "a"), MERGE)
    tables.merge("n", batch(spark, 0, 5000, "a"), MERGE)
    before = files(tmp_path / "n")
    assert len(before) == 64
    small = batch(spark, 4990, 5010, "b")
    touched = {
        f"{sinks.PART}={r.p}" for r in small.select(sinks.bucket_part(("k",), 64).alias("p")).distinct().collect()
    }
    tables.merge("n", small, MERGE)
    after = files(tmp_path / "n")
    assert 0 < len(touched) <= 20 and tables.current_version("n") == 1
    assert all(after[p] == before[p] for p in before if p not in touched)
    assert all(not set(after[p]) & set(before[p]) for p in touched)
    assert rows(tables.read("n")) == rows(upsert(whole, small, MERGE))
    tables.merge("n", small, MERGE)
    assert rows(tables.read("n")) == rows(upsert(whole, small, MERGE))


def test_only_touched_buckets_are_read(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path), buckets={"n": 8})
    tables.merge("n", batch(spark, 0, 100, "a"), MERGE)
    stored = spark.read.parquet(tables._folder("n", 1)).filter(F.col(sinks.PART).isin("b1", "b2"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan.replace("isnotnull(", "") or "_part#" in plan.split("PartitionFilters")[1][:60]


@pytest.mark.parametrize("empty_first", [True, False])
def test_empty_batches_new_columns_and_null_keys(spark, tmp_path, empty_first):
    tables = TableSet(spark, str(tmp_path), buckets={"n": 4})
    if empty_first:
        tables.merge("n", batch(spark, 0, 0, "a"), MERGE)
        assert tables.read("n").isEmpty()
    old = batch(spark, 0, 9, "a").withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    tables.merge("n", old, MERGE)
    tables.merge("n", batch(spark, 0, 0, "z"), MERGE)
    wider = Merge(("k",), ("first",), ("last", "extra"))
    more = batch(spark, 5, 12, "b").withColumn("extra", F.lit(1))
    tables.merge("n", more, wider)
    expected = upsert(upsert(None, old, MERGE), more, wider)
    assert rows(tables.read("n")) == rows(expected) and tables.read("n").columns == expected.columns


def test_a_whole_table_becomes_dealt_and_whole_again(spark, tmp_path):
    plain, dealt = TableSet(spark, str(tmp_path)), TableSet(spark, str(tmp_path), buckets={"n": 4})
    plain.merge("n", batch(spark, 0, 9, "a"), MERGE)
    dealt.merge("n", batch(spark, 5, 12, "b"), MERGE)
    assert files(tmp_path / "n").keys() > {"version=000001"}
    expected = upsert(upsert(None, batch(spark, 0, 9, "a"), MERGE), batch(spark, 5, 12, "b"), MERGE)
    assert rows(plain.read("n")) == rows(expected)
    dealt.write("n", expected.filter("k < 3"))
    assert rows(plain.read("n")) == rows(expected.filter("k < 3"))


def test_a_run_replaces_only_its_own_part(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    seen = Merge(("id", "run_id"), ("first",), ("last",))

    def edges(run, tag, n=20):
        return spark.range(n).select(
            "id", F.lit(run).alias("run_id"), F.lit(tag).alias("first"), F.lit(tag).alias("last"), F.col("id").alias("_seq")
        )

    tables.merge("e", edges("run/1 =x", "a"), seen)
    first = files(tmp_path / "e")
    tables.merge("e", edges("007", "b"), seen)
    tables.merge("e", edges("007", "c", 25), seen)
    after = files(tmp_path / "e")
    assert len(first) == 1 and len(after) == 2 and all(after[p] == first[p] for p in first)
    got = {(r.run_id, r.first, r["last"]): r.n for r in tables.read("e").groupBy("run_id", "first", "last").agg(F.count("id").alias("n")).collect()}
    assert got == {("run/1 =x", "a", "a"): 20, ("007", "b", "c"): 20, ("007", "c", "c"): 5}

    for loader in ("x", "y"):
        tables.replace_run("r", edges("1", loader).select("id", "run_id", "first"), "1", loader)
    before = files(tmp_path / "r")
    tables.replace_run("r", edges("1", "again", 3).select("id", "run_id", "first"), "1", "y")
    assert sorted(r.first for r in tables.read("r").collect()) == ["again"] * 3 + ["x"] * 20
    assert sum(files(tmp_path / "r")[p] == before[p] for p in before) == 1


def test_runs_without_rows_leave_a_table_that_can_be_read(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    none = spark.createDataFrame([], "run_id string, n int")
    for run in ("r1", "r2", "r3"):
        tables.replace_run("rejected", none, run)
    again = TableSet(spark, str(tmp_path))
    assert again.read("rejected").columns == ["run_id", "n"] and again.read("rejected").isEmpty()
    again.replace_run("rejected", spark.createDataFrame([("r2", 1)], "run_id string, n int"), "r2")
    assert [tuple(r) for r in TableSet(spark, str(tmp_path)).read("rejected").collect()] == [("r2", 1)]
