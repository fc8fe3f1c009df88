"""Ball k-means against plain k-means in Python's integers."""

import math

import numpy as np
import pytest

from jobweave.llm import ballkmeans

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, code int, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, "y") for i, v, l in rows], SCHEMA)


def plain(rows, parts, entries, rounds):
    """{position in rows: (code, error)} and the codebooks, every part against every entry."""
    cells = [[math.floor(4096 * x) for x in v] for _, v, _ in rows]
    cells = [c + [0] * (-len(c) % parts) for c in cells]
    size = len(cells[0]) // parts
    cut = lambda c, p: c[p * size : (p + 1) * size]
    order = sorted((k for k, r in enumerate(rows) if r[0] is not None), key=lambda k: (rows[k][0], rows[k][1]))
    books = [[cut(cells[k], p) for k in order[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for number in range(rounds + 1):
        near = [[min((square(cut(c, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cells]
        if number == rounds:
            return [(bytes(j for _, j in n), sum(d for d, _ in n)) for n in near], books
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(c, p) for c, n in zip(cells, near) if n[p][1] == j]
                if own:
                    books[p][j] = [sum(xs) // len(own) for xs in zip(*own)]


def compared(spark, rows, **options):
    coded, books = ballkmeans.encode(frame(spark, rows).repartition(3), **options)
    sizes = {"parts": 8, "entries": 16, "rounds": 6} | options
    expected, entries = plain(rows, **sizes)
    assert books.entries.tolist() == entries
    got = sorted((str(r.vec_id), bytes(r.code), r.error) for r in coded.collect())
    assert got == sorted((str(i), code, error) for (i, _, _), (code, error) in zip(rows, expected))


def test_same_codes_as_plain_k_means(spark):
    rng = np.random.default_rng(5)
    spread = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(300)]
    compared(spark, spread)


def test_ties_copies_and_null_ids(spark):
    rng = np.random.default_rng(6)
    # Few values in each place, so many distances are equal and a third of all rows are one vector.
    rows = [(i, (rng.integers(-2, 3, 8) / 4096).tolist(), None) for i in range(200)]
    rows += [(1000 + i, [0.5] * 8, 7) for i in range(100)] + [(3, rows[5][1], 1), (None, [1.0] * 8, 1)]
    compared(spark, rows, entries=5)
    compared(spark, rows[:4], rounds=2)


def test_large_components_and_lengths_that_do_not_divide(spark):
    rng = np.random.default_rng(7)
    compared(spark, [(i, (rng.normal(size=11) * 3e4).tolist(), 1) for i in range(60)], parts=4, entries=4, rounds=3)


def test_pruned_distances(spark):
    rng = np.random.default_rng(8)
    centres = rng.integers(-9000, 9000, (16, 4)).astype(float)
    cells = np.concatenate([c + rng.integers(-300, 300, (50, 4)) for c in centres])
    codes = ballkmeans.first_codes(cells, centres)
    again, best, computed = ballkmeans.moved_codes(cells, centres, codes)
    assert (again == codes).all() and computed < 2 * len(cells)
    moved = centres + rng.integers(-4000, 4000, centres.shape)
    found, best, _ = ballkmeans.moved_codes(cells, moved, codes)
    squares = ((cells[:, None] - moved) ** 2).sum(-1)
    assert (found == squares.argmin(1)).all() and (best == squares.min(1)).all()


def test_odd_rows(spark):
    good = [(i, [float(i), 1.0, -0.3, 2.0, 0.0, 0.0, 0.0, 1.5], None if i % 2 else 4) for i in range(20)]
    odd = [
        (-1, None, 1), (-2, [], 1), (-3, [float("nan")] * 8, 1), (-4, [1.0, None] * 4, 1),
        (-5, [float("inf")] * 8, 1), (77, [1.0] * 9, 1),
    ]
    coded, _ = ballkmeans.encode(frame(spark, good + odd))
    rows = ballkmeans.with_group_error(coded).collect()
    assert {r.vec_id for r in rows} == set(range(20))
    for label in {r.label for r in rows}:
        group = [r for r in rows if r.label == label]
        assert {r.label_error for r in group} == {sum(r.error for r in group)}
    for nothing in (frame(spark, odd[:5]), frame(spark, good).limit(0), frame(spark, [(None, [1.0] * 8, 1)])):
        coded, books = ballkmeans.encode(nothing)
        assert books is None and coded.isEmpty()
        assert coded.columns == ["vec_id", "label", "code", "error"]
    huge = frame(spark, [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1)])
    assert ballkmeans.encode(huge, entries=1)[0].count() == 2
