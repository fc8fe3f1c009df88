"""Nearest neighbours on large tables: what a shard, a shuffle and a task's answer may hold."""

from collections import Counter

import numpy as np
import pytest

from jobweave.llm import vptree


def plain_nearest(rows, k):
    """(query_id, rank, vec_id, score) by all pairs; repeated queries and candidates count each."""
    out = []
    for query in sorted({i for i, _ in rows if i % 50 == 0}):
        found = []
        for i, a in rows:
            if i == query:
                for j, b in rows:
                    if j != query and len(a) == len(b):
                        a_, b_ = np.array([a], float), np.array([b], float)
                        score = vptree.dot(a_, b_) / (np.sqrt(vptree.dot(a_, a_)) * np.sqrt(vptree.dot(b_, b_)))
                        found.append((-score[0], j))
        out += [(query, rank, j, -score) for rank, (score, j) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_repeated_id_fills_no_shard_and_all_dimensions_are_found(spark, kind):
    rng = np.random.default_rng(3)
    draw = lambda dims: rng.normal(size=dims).astype(np.float32).tolist()
    rows = [(i, draw(8)) for i in range(120)] + [(50, draw(8)) for _ in range(60)]
    rows += [(i, draw(3)) for i in range(200, 260)]
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    index = vptree.build_index(frame, shard_rows=10)
    shards = index.selectExpr("dims", "length(ids) / 8 AS n").collect()
    assert Counter(len(v) for _, v in rows) == sum((Counter({r.dims: int(r.n)}) for r in shards), Counter())
    assert max(r.n for r in shards) <= 15
    found = vptree.nearest(index, frame.filter("vec_id % 50 = 0"), block_rows=4).collect()
    assert sorted(map(tuple, found)) == plain_nearest(rows, 5)


def test_no_block_is_shuffled_for_each_shard(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = vptree.nearest(vptree.staged_index(frame, shard_rows=20), frame, block_rows=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange hashpartitioning" not in below


def test_a_task_returns_k_rows_of_a_query_whatever_its_trees(spark):
    rng = np.random.default_rng(5)
    vectors, ids = rng.normal(size=(400, 6)), np.arange(400)
    frame = spark.createDataFrame(list(zip(ids.tolist(), vectors.tolist())), "vec_id bigint, embedding array<double>")
    pairs = vptree.build_index(frame, shard_rows=40).coalesce(1).crossJoin(
        spark.createDataFrame(
            [(6, ids[:7].tobytes(), vectors[:7].tobytes(), 0)], "q_dims int, q_ids binary, q_vectors binary, block bigint"
        ).coalesce(1)
    )
    found = pairs.mapInArrow(vptree._search(3, 1.0), vptree._FOUND).collect()
    assert Counter(r.query_id for r in found) == {i: 3 for i in range(7)}
