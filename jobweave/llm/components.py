"""Connected components, in one task for a bounded group and in Spark for any graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobweave.sources.files import StagedFolder


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``a[i]`` and ``b[i]`` in place; a label is its class's least index."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped


def _two_way(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = _two_way(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return handed.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that is not the least of its component.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; loops are
    ignored, repeated edges count once, and nulls are not nodes. The component
    is named after its least node. Alternating large and small stars need about
    log(longest path) rounds. Each round is written to the shared folder, so a
    lost executor costs one round at most; only a count and a checksum reach
    the driver.
    """
    folder = StagedFolder(edges.sparkSession, "components")
    oriented = (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state, _ = folder.write(oriented, "round-0")
    before, number = None, 0
    while True:
        number += 1
        seen = Observation()
        target = f"{folder.root}/round-{number}"
        stars = _small_star(_large_star(state))
        stars.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("mix"),
        ).write.parquet(target)
        state = edges.sparkSession.read.schema(stars.schema).parquet(target)
        now = (seen.get["rows"], seen.get["mix"])
        if now == before or now[0] == 0:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
