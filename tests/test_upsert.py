import random

import pytest
from pyspark.sql import functions as F

from jobweave.operators.upsert import (
    Merge, collapse, dimension, fixed_children, optional_reference, provenance, rename_keys,
    require_parents, union_in_order, upsert,
)

MERGE = Merge(("k",), ("c",), ("s",), ("o",))
SCHEMA = "k int, c int, s int, o int, _seq int"


def rows(frame):
    return {tuple(r) for r in frame.collect()}


def brute_force(state, batch):
    state = dict(state)
    for k, c, s, o, _ in sorted(batch, key=lambda r: r[4]):
        if k in state:
            old_c, _, old_o = state[k]
            state[k] = (old_c, s, old_o if o is None else o)
        else:
            state[k] = (c, s, o)
    return {(k, *v) for k, v in state.items()}


@pytest.mark.parametrize("seed", range(4))
def test_matches_row_by_row_merging(spark, seed):
    rng = random.Random(seed)

    def batch(n):
        return [
            (rng.randrange(6), *[rng.choice([None, rng.randrange(9)]) for _ in range(3)], i)
            for i in range(n)
        ]

    first, second = batch(25), batch(25)
    rng.shuffle(second)
    once = upsert(None, spark.createDataFrame(first, SCHEMA).repartition(3), MERGE)
    twice = upsert(once, spark.createDataFrame(second, SCHEMA).repartition(3), MERGE)
    expected = brute_force({}, first)
    assert rows(once) == expected
    assert rows(twice) == brute_force({r[0]: r[1:] for r in expected}, second)
    again = upsert(twice, spark.createDataFrame(second, SCHEMA), MERGE)
    assert rows(again) == rows(twice)
    small = upsert(once, spark.createDataFrame(second, SCHEMA), MERGE, small=True)
    assert rows(small) == rows(twice) and small.count() == twice.count()


def test_explicit_null_overwrites_but_keep_old_does_not(spark):
    old = spark.createDataFrame([(1, 10, 20, 30)], "k int, c int, s int, o int")
    new = spark.createDataFrame([(1, 11, None, None, 0)], SCHEMA)
    assert rows(upsert(old, new, MERGE)) == {(1, 10, None, 30)}


def test_create_only_null_of_an_existing_row_stays_null(spark):
    old = spark.createDataFrame([(1, None, 2, 3)], "k int, c int, s int, o int")
    new = spark.createDataFrame([(1, 9, 9, 9, 0)], SCHEMA)
    assert rows(upsert(old, new, MERGE)) == {(1, None, 9, 9)}


def test_stub_leaves_other_columns(spark):
    old = spark.createDataFrame([(1, "full")], "k int, name string")
    stubs = spark.createDataFrame([(1, 0), (2, 1), (2, 2)], "k int, _seq int")
    for small in (True, False):
        merged = upsert(old, stubs, Merge(("k",)), small=small)
        assert rows(merged) == {(1, "full"), (2, None)}


def test_new_columns_are_added(spark):
    old = spark.createDataFrame([(1,)], "k int")
    new = spark.createDataFrame([(2, 5, 0)], "k int, v int, _seq int")
    for small in (True, False):
        merged = upsert(old, new, Merge(("k",), set_columns=("v",)), small=small)
        assert rows(merged) == {(1, None), (2, 5)}


def test_a_small_batch_does_not_shuffle_the_table(spark, tmp_path):
    spark.range(1000).selectExpr("id k", "id v").write.parquet(str(tmp_path / "table"))
    spark.range(5).selectExpr("id k", "-id v", "id _seq").write.parquet(str(tmp_path / "batch"))
    table, batch = (spark.read.parquet(str(tmp_path / n)) for n in ("table", "batch"))
    merge = Merge(("k",), (), ("v",))
    merged = upsert(table, batch, merge, small=True)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for shuffled in ("SortMergeJoin", "ShuffledHashJoin", "FullOuter"):
        assert shuffled not in plan
    large = upsert(table, batch, merge, small=False)
    assert "FullOuter" in large._jdf.queryExecution().executedPlan().toString()
    assert rows(large) == rows(merged)


def test_edge_key_with_property(spark):
    edges = spark.createDataFrame(
        [("a", "b", "x", 1, 0), ("a", "b", "y", 2, 1), ("a", "b", "x", 3, 2)],
        "src string, dst string, via string, v int, _seq int",
    )
    by_ends = collapse(edges, Merge(("src", "dst"), ("v",)))
    by_property = collapse(edges, Merge(("src", "dst", "via"), (), ("v",)))
    assert rows(by_ends) == {("a", "b", 1)}
    assert rows(by_property) == {("a", "b", "x", 3), ("a", "b", "y", 2)}


def test_parents(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "p int, v string")
    parent = spark.createDataFrame([(1,), (3,)], "id int")
    kept, dropped = require_parents(child, parent, {"p": "id"})
    assert rows(kept) == {(1, "a")} and rows(dropped) == {(2, "b"), (None, "c")}


def test_small_builders(spark):
    frame = spark.createDataFrame([(1, "x"), (2, " "), (3, None), (4, "x")], "id int, ref string")
    assert rows(optional_reference(frame, "ref")) == {(1, "x"), (4, "x")}
    assert rows(dimension(frame, "ref", "name")) == {("x",), (" ",)}
    assert fixed_children(frame.select("id"), ("e", "b")).count() == 8
    assert rows(rename_keys(frame, "ref", {"x": "y"}).select("ref")) == {("y",), (" ",), (None,)}
    edges = provenance(frame, ["id"], "r", "BMC", F.lit("2024-01-01").cast("timestamp"))
    assert edges.count() == 4


def test_sources_in_order(spark):
    first = spark.createDataFrame([(1, "in", 99)], "k int, source string, _seq int")
    second = spark.createDataFrame([(1, "out", 0), (2, "out", 1)], "k int, source string, _seq int")
    merged = upsert(None, union_in_order(first, second), Merge(("k",), ("source",)))
    assert rows(merged) == {(1, "in"), (2, "out")}


def test_hot_key_is_reduced_before_the_shuffle(spark):
    batch = spark.range(1000).select(
        F.lit(1).alias("k"), F.col("id").alias("s"), F.col("id").alias("_seq")
    )
    collapsed = collapse(batch, Merge(("k",), (), ("s",)))
    plan = collapsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") >= 1
    assert rows(collapsed) == {(1, 999)}
