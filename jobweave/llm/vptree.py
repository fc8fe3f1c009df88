"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one, where a larger cosine is a smaller Euclidean
distance, so the triangle inequality holds. A tree splits the vectors of a
shard by their distance to a vantage point. A search leaves out a branch whose
distances cannot come nearer than the k-th best so far; ``factor`` below one
shrinks that radius and prunes more, factor one keeps the search exact.

Trees are built once and written as rows of the index; blocks of queries are
written once and meet every tree without a shuffle. A task carries what it found
for a query from tree to tree, and each query's best of all tasks are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import FloatType, _parse_datatype_string

from jobweave.llm.common import slices
from jobweave.sources.files import stage

LEAF = 64
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
#: Trees or blocks that one task writes at most, beyond the session's shuffle partitions.
TASK_PACKS = 16
#: Tasks, or as many as run at once, that the trees are dealt to; each returns its best of every query.
TREE_TASKS = 24
#: Rounding of cosines that must not prune.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of products over the last axis, added from the first component on."""
    total = left[..., 0] * right[..., 0]
    for i in range(1, left.shape[-1]):
        total = total + left[..., i] * right[..., i]
    return total


def dot_of_rows(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``dot(left[a], right[b])``, to the last bit: an accumulation adds one component after the other."""
    total = np.empty(len(a))
    for start in range(0, len(a), BLOCK_ROWS):
        part = slice(start, start + BLOCK_ROWS)
        total[part] = np.add.accumulate(left[a[part]] * right[b[part]], axis=1)[:, -1]
    return total


@dataclass
class Tree:
    """A balanced tree over rows in tree order.

    Node i covers rows first[i] to last[i]; its vantage point is row first[i].
    Children 2i + 1 and 2i + 2 halve the other rows by distance; near[i] and
    far[i] bound the distances of node i's rows from its parent's vantage point.
    """

    ids: np.ndarray
    vectors: np.ndarray
    first: np.ndarray
    last: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        depth = 0
        while len(ids) >> depth > LEAF:
            depth += 1
        nodes = (2 << depth) - 1
        first, last = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        near, far = np.zeros(nodes), np.full(nodes, 2.0)
        order = np.argsort(ids, kind="stable")
        unit = vectors / np.sqrt(dot(vectors, vectors))[:, None]
        last[0] = len(ids)
        for node in range((1 << depth) - 1):
            a, b = first[node], last[node]
            if b - a < 2:
                first[2 * node + 1 : 2 * node + 3] = last[2 * node + 1 : 2 * node + 3] = b
                continue
            rest = order[a + 1 : b]
            away = np.sqrt(np.maximum(2 - 2 * (unit[rest] @ unit[order[a]]), 0))
            rank = np.argsort(away, kind="stable")
            order[a + 1 : b], away = rest[rank], away[rank]
            middle = (b - a - 1) // 2
            for child, lo, hi in ((2 * node + 1, 0, middle), (2 * node + 2, middle, b - a - 1)):
                first[child], last[child] = a + 1 + lo, a + 1 + hi
                if hi > lo:
                    near[child], far[child] = away[lo], away[hi - 1]
        return cls(ids[order], vectors[order], first, last, near, far)

    @cached_property
    def length(self) -> np.ndarray:
        return np.sqrt(dot(self.vectors, self.vectors))

    @cached_property
    def unit(self) -> np.ndarray:
        return self.vectors / self.length[:, None]

    def search(
        self,
        ids: np.ndarray,
        queries: np.ndarray,
        k: int,
        factor: float,
        held: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, cosines) of the k best of each query, -1 where there are fewer, and pairs measured.

        ``held`` has what was found in other trees; the best of both are returned.
        Queries walk together, the branch that is nearest to most of them first.
        """
        q_length, length, unit = np.sqrt(dot(queries, queries)), self.length, self.unit
        q_unit = queries / q_length[:, None]
        if held is None:
            held = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf)
        best_id, best = held[0].copy(), held[1].copy()
        measured = 0

        def units(who: np.ndarray) -> np.ndarray:
            return q_unit if len(who) == len(q_unit) else q_unit[who]

        def offer(who: np.ndarray, a: int, b: int) -> None:
            nonlocal measured
            measured += len(who) * (b - a)
            # The matrix product only finds who may enter; scores are then added in a fixed order,
            # so equal vectors score alike wherever they lie.
            near, least = units(who) @ unit[a:b].T, best[who, -1]
            if b - a > k and least.min() == -np.inf:
                # Who holds fewer than k needs no more than the k best of these rows.
                near[ids[who][:, None] == self.ids[a:b]] = -np.inf
                least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - SLACK)
            row, column = np.divmod(np.flatnonzero(near >= least[:, None] - SLACK), b - a)
            other = self.ids[a + column] != ids[who[row]]
            row, at = row[other], a + column[other]
            if not len(row):
                return
            cosine = dot_of_rows(queries, who[row], self.vectors, at) / (q_length[who[row]] * length[at])
            touched = np.unique(row)
            changed = who[touched]
            of = np.concatenate([np.repeat(touched, k), row])
            scores = np.concatenate([best[changed].ravel(), cosine])
            names = np.concatenate([best_id[changed].ravel(), self.ids[at]])
            order = np.lexsort((names, -scores, of))
            first = np.searchsorted(of[order], touched)
            kept = order[first[:, None] + np.arange(k)]
            best[changed], best_id[changed] = scores[kept], names[kept]

        # A cosine is rounded by up to dims * eps, a distance near 0 by the root of that.
        rounding = SLACK + 4 * np.sqrt(queries.shape[1] * np.finfo(float).eps)

        def radius(who: np.ndarray) -> np.ndarray:
            return factor * np.sqrt(np.maximum(2 - 2 * best[who][:, -1], 0)) + rounding

        leaves = len(self.first) // 2
        pending = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while pending:
            node, who, gap = pending.pop()
            keep = gap <= radius(who)
            who = who[keep]
            a, b = self.first[node], self.last[node]
            if not len(who) or a == b:
                continue
            if node >= leaves:
                offer(who, a, b)
                continue
            offer(who, a, a + 1)
            away = np.sqrt(np.maximum(2 - 2 * (units(who) @ unit[a]), 0))
            gaps = [
                np.maximum(np.maximum(self.near[c] - away, away - self.far[c]), gap[keep])
                for c in (2 * node + 1, 2 * node + 2)
            ]
            # All queries take one child first: dealt by their own order they would part at every level.
            inner = int(2 * np.count_nonzero(gaps[0] <= gaps[1]) < len(who))
            for c in (1 - inner, inner):
                pending.append((2 * node + 1 + c, who, gaps[c]))
        best_id[best == -np.inf] = -1
        return best_id, best, measured


_TREE = "dims int, ids binary, vectors binary, first binary, last binary, near binary, far binary"
_BLOCK = "q_dims int, q_ids binary, q_vectors binary"
_FOUND = "query_id bigint, vec_id bigint, score double, measured bigint"


def _packed(
    rows: DataFrame, size: int, schema: str, make: Callable[[np.ndarray, np.ndarray], dict]
) -> DataFrame:
    """One row for about ``size`` vectors of a dimension, from half to one and a half times as many.

    Only the last of a task and dimension may have fewer. Rows are dealt evenly whatever their ids, so
    neither a repeated id nor a large table makes a task hold more than one pack of each dimension.
    """
    spark = rows.sparkSession
    packs = max(1, -(-rows.select("id").count() // size))
    tasks = max(-(-packs // TASK_PACKS), min(packs, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    most = size + size // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for part in slices(batches):
            for dims in pc.unique(part.column("dims")).to_pylist():
                own = part.filter(pc.equal(part.column("dims"), dims))
                ids, vectors = held.setdefault(dims, ([], []))
                ids.append(own.column("id").to_numpy())
                vectors.append(own.column("vector").flatten().to_numpy().reshape(-1, dims))
                if sum(map(len, ids)) > most:
                    all_ids, matrix = np.concatenate(ids), np.concatenate(vectors)
                    while len(all_ids) > most:
                        yield pa.RecordBatch.from_pylist([make(all_ids[:size], matrix[:size])], arrow)
                        all_ids, matrix = all_ids[size:], matrix[size:]
                    held[dims] = [all_ids], [matrix]
        for ids, vectors in held.values():
            yield pa.RecordBatch.from_pylist([make(np.concatenate(ids), np.concatenate(vectors))], arrow)

    return rows.repartition(tasks).mapInArrow(run, schema)


def _matrix(raw: pa.Buffer, dims: int, rows: int) -> np.ndarray:
    """Vectors in double precision, from the width they were written in."""
    return np.frombuffer(raw, f"f{raw.size // (rows * dims)}").reshape(rows, dims).astype(np.float64)


def build_index(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per shard of about ``shard_rows`` vectors, with its tree; every usable row is in one.

    Unusable vectors take no part; null ids neither, since no result could name them.
    """

    def make(ids: np.ndarray, matrix: np.ndarray) -> dict:
        tree = Tree.build(ids, matrix.astype(np.float64))
        parts = {n: getattr(tree, n).tobytes() for n in ("ids", "first", "last", "near", "far")}
        return {"dims": matrix.shape[1], "vectors": tree.vectors.astype(matrix.dtype).tobytes(), **parts}

    return _packed(_usable_rows(vectors, id_col, vector_col), shard_rows, _TREE, make)


def _usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, dims) of usable rows; floats stay floats until they are measured."""
    given = vectors.select(F.col(vector_col).alias("vector")).schema["vector"].dataType
    kind = "float" if isinstance(getattr(given, "elementType", None), FloatType) else "double"
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector")
    )
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    return rows.withColumn("dims", F.size("vector"))


def _search(k: int, factor: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By block: its queries, and the ids and cosines of their best in all trees so far.
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        tree, opened, measured = None, (b"", b""), 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                dims = row["dims"].as_py()
                if dims != row["q_dims"].as_py():
                    continue
                raw = {n: x.as_buffer() for n, x in row.items() if pa.types.is_binary(x.type)}
                if not all(raw[n].equals(pa.py_buffer(x)) for n, x in zip(("ids", "vectors"), opened)):
                    opened = raw["ids"].to_pybytes(), raw["vectors"].to_pybytes()
                    ids, first, last = (np.frombuffer(raw[n].to_pybytes(), np.int64) for n in ("ids", "first", "last"))
                    near, far = (np.frombuffer(raw[n].to_pybytes()) for n in ("near", "far"))
                    tree = Tree(ids, _matrix(raw["vectors"], dims, len(ids)), first, last, near, far)
                block = row["block"].as_py()
                queries = np.frombuffer(raw["q_ids"].to_pybytes(), np.int64)
                found, cosine, pairs = tree.search(
                    queries, _matrix(raw["q_vectors"], dims, len(queries)), k, factor, best[block][1:] if block in best else None
                )
                best[block] = queries, found, cosine
                measured += pairs
        for queries, found, cosine in best.values():
            hit = found.ravel() >= 0
            columns = [np.repeat(queries, k)[hit], found.ravel()[hit], cosine.ravel()[hit]]
            columns.append(np.where(np.arange(hit.sum()) == 0, measured, 0))
            measured = 0
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "measured"])

    return run


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int = 5,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of each query, itself left out.

    ``score`` is the cosine of the original vectors in double precision; ties
    go to the smaller id. ``factor`` 1 finds the true nearest; less prunes
    harder, and what it finds depends on how the vectors are dealt. Unusable
    queries give no rows; vectors of another dimension are no candidates; with
    fewer candidates there are fewer rows. Repeated ids are candidates each.

    Queries are written in blocks of about ``block_rows``. Tasks read trees and blocks again for each pair
    of their parts, so neither is multiplied on disk, and return at most ``k`` rows per query each.
    """

    def make(ids: np.ndarray, matrix: np.ndarray) -> dict:
        order = np.argsort(ids, kind="stable")
        return {"q_dims": matrix.shape[1], "q_ids": ids[order].tobytes(), "q_vectors": matrix[order].tobytes()}

    packed = _packed(_usable_rows(queries, id_col, vector_col), block_rows, _BLOCK, make)
    blocks = stage(packed.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    tasks = max(TREE_TASKS, index.sparkSession.sparkContext.defaultParallelism)
    # Equal dimensions are no join key: all rows could share one.
    found = index.coalesce(tasks).crossJoin(blocks).mapInArrow(_search(k, factor), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def staged_index(vectors: DataFrame, **options) -> DataFrame:
    """:func:`build_index`, written to the shared folder so that trees are built once."""
    return stage(build_index(vectors, **options), "vantage-trees")
