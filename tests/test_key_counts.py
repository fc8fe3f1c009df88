"""Key counts by run against a full check of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from jobweave.operators import quality
from jobweave.sinks.key_counts import KeyCounts
from jobweave.sinks.tables import TableSet
from test_tables import files

SCHEMA = "run string, a string, b double, other int"


class CoarseCounts(KeyCounts):
    """Seven hashes only, so that most doubts are about different keys."""

    def key_hash(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(7))


def loaded(spark, held):
    rows = [(run, *row, i) for run, found in held.items() for i, row in enumerate(found)]
    return spark.createDataFrame(rows, SCHEMA)


def whole(frame):
    return quality.key_report(frame, ["a", "b"], "k").collect()


@pytest.mark.parametrize("kind", [KeyCounts, CoarseCounts])
def test_reports_equal_the_full_check_after_each_load(spark, tmp_path, kind):
    counts, held = kind(TableSet(spark, str(tmp_path)), "t", ["a", "b"]), {}
    draw = random.Random(3)
    some = lambda n: [(draw.choice(["x", "y", "z", None]), draw.choice([0.5, 1.0, 2.0, None])) for _ in range(n)]
    steps = [
        ("r1", [("x", 0.0), ("y", 1.0)]),
        ("r2", [("x", -0.0), ("q", float("nan"))]),  # the first key again, by another zero
        ("r3", []),
        ("r1", [("y", 1.0)]),  # a replay with fewer rows takes the duplicate away
        ("r4", some(12)),
        ("r5", [("q", float("nan")), (None, None)]),
        ("r4", []),
        ("r2", some(5)),
    ]
    seen = []
    for run, found in steps:
        held[run] = found
        counts.add(loaded(spark, {run: found}), run)
        frame = loaded(spark, held)
        want = whole(frame)
        assert counts.report(frame, "k", "run").collect() == want
        seen.append((want[0].null_keys, want[0].duplicate_keys))
    assert counts.report(frame, "k").collect() == want
    assert counts.check(frame, "k").collect() == quality.check_key(frame, ["a", "b"], "k").collect()
    assert seen[:4] == [(0, 0), (0, 1), (0, 1), (0, 0)] and len(set(seen)) > 3


def test_other_runs_stay_and_no_doubt_reads_no_row(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    counts = KeyCounts(tables, "t", ["id"])
    rows = spark.range(3000).withColumn("run", F.concat(F.lit("r"), (F.col("id") / 1000).cast("int")))
    for run in ("r0", "r1"):
        counts.add(rows.filter(F.col("run") == run), run)
    before = files(tmp_path / "t_key_count")
    counts.add(rows.filter("run = 'r2'"), "r2")
    after = files(tmp_path / "t_key_count")
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert counts.runs_in_doubt() == []
    plan = counts.duplicates(rows, "run")._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan
    assert counts.report(rows, "k", "run").first().duplicate_keys == 0
    # A key of one run that another brings again: only those two are read.
    counts.add(spark.createDataFrame([(1500,)], "id bigint"), "late")
    assert counts.runs_in_doubt() == ["late", "r1"]
    more = rows.unionByName(spark.createDataFrame([(1500, "late")], "id bigint, run string"))
    assert [tuple(r) for r in counts.duplicates(more, "run").collect()] == [(1500, 2)]


def test_doubtful_rows_are_moved_once(spark, tmp_path):
    """Rows the join has moved by their hash are grouped where they are; a run's staged counts are not dealt again."""
    rows = loaded(spark, {"r1": [("x", 1.0), ("x", 1.0), ("y", 2.0)]})
    counts = KeyCounts(TableSet(spark, str(tmp_path)), "t", ["a", "b"])
    counts.add(rows, "r1")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        twice = counts.duplicates(rows)
        plan = twice._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2
    assert [tuple(r) for r in twice.collect()] == [("x", 1.0, 2)]
