"""Product codes of vectors by ball k-means, in whole numbers.

Every part position of the vectors has a codebook of its own. An entry and its
members are a ball. An entry is a neighbour if half its distance is within the
ball's radius; members closer to their entry than half the way to the nearest
neighbour are a stable core and keep their code without another distance; a
member in the k-th ring may only move to one of the k nearest neighbours, and
those distances are computed exactly. Balls are taken per batch of rows, which
makes their radii, and so the sets of neighbours, no larger than a whole ball's.

A round is one Spark job that reads the rows with their codes, writes them with
new codes and adds its part of every entry's sums to the same files. Only those
sums, whose number depends on the codebooks alone, reach the driver; the rows of
the round before are deleted. A lost executor costs its tasks of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.sources.files import StagedFolder

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components count as at most this much, so that a product of two is still a whole number.
LARGEST = 1 << 53
#: Rows whose distances to all entries are held at once.
_ROWS = 2048
_LONG = (1 << 63) - 1


def whole(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(row, part, position): floor(SCALE * x), filled up with zeros to equal parts."""
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST)
    missing = -scaled.shape[1] % parts
    return np.pad(scaled, ((0, 0), (0, missing))).reshape(len(scaled), parts, -1)


def exact(cells: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles while four times any squared distance is a whole number there, else as Python's integers."""
    most = max(np.abs(cells).max(initial=0), np.abs(entries).max(initial=0))
    if 16 * float(most) ** 2 * cells.shape[-1] < 2**53:
        return cells, entries.astype(np.float64)
    to_int = np.frompyfunc(int, 1, 1)
    return to_int(cells), to_int(entries)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def first_codes(cells: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each row of one part; ties go to the lower index."""
    codes = np.empty(len(cells), np.int64)
    for i in range(0, len(cells), _ROWS):
        codes[i : i + _ROWS] = _square(cells[i : i + _ROWS, None], entries).argmin(1)
    return codes


def moved_codes(cells: np.ndarray, entries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, squared distances, distances computed) of one part's rows that had ``codes`` before."""
    best = _square(cells, entries[codes])
    between = _square(entries[:, None], entries)
    result, computed = codes.copy(), len(cells)
    for entry in np.unique(codes):
        members = np.flatnonzero(codes == entry)
        own = 4 * best[members]
        near = [j for j in np.argsort(between[entry], kind="stable") if j != entry and between[entry, j] <= own.max()]
        ring = np.searchsorted(between[entry, near], own, side="right") if near else np.zeros(len(members), np.int64)
        for k, other in enumerate(near):
            rows = members[ring > k]
            distance = _square(cells[rows], entries[other])
            computed += len(rows)
            better = (distance < best[rows]) | ((distance == best[rows]) & (other < result[rows]))
            best[rows[better]], result[rows[better]] = distance[better], other
    return result, best, computed


@dataclass(frozen=True)
class Codebooks:
    """Entries (part, entry, position) as Python integers; ``width`` is the vectors' length."""

    entries: np.ndarray
    width: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def updated(self, sums: dict[int, tuple[int, int]]) -> Codebooks:
        """Each entry becomes the floor of its members' mean; one without members stays."""
        moved = self.entries.copy().ravel()
        for cell, (total, count) in sums.items():
            moved[cell] = total // count
        return Codebooks(moved.reshape(self.entries.shape), self.width)


def _coded(books: Codebooks, last: bool):
    """Rows with new codes; but for the last pass, then one row per sum of an entry's component."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.entries.shape, object), np.zeros((parts, entries), object)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            before = [np.frombuffer(c, np.uint8) for c in batch.column("code").to_pylist() if c is not None]
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            cells, centres = exact(whole(vectors.reshape(rows, books.width), parts), books.entries)
            codes, error = np.empty((rows, parts), np.uint8), np.zeros(rows, object)
            for part in range(parts):
                own = np.stack(before)[:, part].astype(np.int64) if before else first_codes(cells[:, part], centres[part])
                own, distance, _ = moved_codes(cells[:, part], centres[part], own)
                codes[:, part] = own
                error += distance.astype(object)
                for entry in np.unique(own):
                    members = cells[own == entry, part]
                    total[part, entry] += np.frompyfunc(int, 1, 1)(members.sum(0))
                    count[part, entry] += len(members)
            errors = [min(int(e), _LONG) for e in error]
            yield _batch(
                batch.column("id"), batch.column("vector"), batch.column("label"),
                pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.int64()),
                *[pa.nulls(rows, t) for t in (pa.int32(), pa.decimal128(38), pa.int64())],
            )
        if not last:
            used = [i for i in range(total.size) if count.ravel()[i // width]]
            sums = [Decimal(total.ravel()[i]) for i in used]
            yield _batch(
                *[pa.nulls(len(used), t) for t in (pa.int64(), pa.list_(pa.float64()), pa.string(), pa.binary(), pa.int64())],
                pa.array(used, pa.int32()), pa.array(sums, pa.decimal128(38)),
                pa.array([count.ravel()[i // width] for i in used], pa.int64()),
            )

    return run


_NAMES = ["id", "vector", "label", "code", "error", "cell", "total", "n"]
SCHEMA = (
    "id bigint, vector array<double>, label string, code binary, error bigint, "
    "cell int, total decimal(38,0), n bigint"
)


def _batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), _NAMES)


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks | None]:
    """(id_col, label as text, code, error) of every usable row, and the codebooks.

    ``code`` has one byte per part; ``error`` is the sum of squared distances to
    the coded entries, at most the largest long. Codebooks start as the parts of
    the rows with the ``entries`` smallest ids (ties by the vector; fewer rows
    give fewer entries) and move ``rounds`` times. Vectors that are null, empty
    or hold a null or non-finite component take no part, nor do those whose
    length differs from that of the smallest id's vector; a length that does not
    divide is filled up with zeros. Repeated rows and null ids are coded each
    time, but a null id starts no entry. Without a usable id the result is empty
    and there are no codebooks. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).cast("string").alias("label"),
    ).filter(usable(F.col("vector")) & (F.size("vector") > 0))
    names = [F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"]
    ordered = rows.filter("id IS NOT NULL").orderBy("id", "vector")
    head = ordered.limit(1).collect()
    if not head:
        empty = rows.filter("false").select("*", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty.select(*names), None
    width = len(head[0].vector)
    rows = rows.filter(F.size("vector") == width)
    start = ordered.filter(F.size("vector") == width).limit(entries).collect()
    cells = whole(np.array([r.vector for r in start]), parts).transpose(1, 0, 2)
    books = Codebooks(np.frompyfunc(int, 1, 1)(cells), width)

    folder = StagedFolder(spark, "ball-k-means")
    empty = [F.lit(None).cast(t).alias(n) for n, t in zip(_NAMES[3:], ("binary", "bigint", "int", "decimal(38,0)", "bigint"))]
    state = rows.select("id", "vector", "label", *empty)
    for number in range(rounds):
        written, _ = folder.write(state.mapInArrow(_coded(books, False), SCHEMA), f"round-{number}")
        sums = written.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        # One row per component of a codebook.
        books = books.updated({r.cell: (int(r.total), r.n) for r in sums.collect()})
        state = written.filter("cell IS NULL")
        if number:
            folder.remove(f"round-{number - 1}")
    coded, _ = folder.write(state.mapInArrow(_coded(books, True), SCHEMA).select("id", "label", "code", "error"), "codes")
    if rounds:
        folder.remove(f"round-{rounds - 1}")
    return coded.select(*names), books


def with_group_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``label_error``: the error summed over equal labels, nulls together; labels may be hot, so they are summed first."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)"))
    summed = coded.groupBy(F.col(label_col).alias("_group")).agg(total.cast("bigint").alias("label_error"))
    return coded.join(summed, F.col(label_col).eqNullSafe(F.col("_group"))).drop("_group")
