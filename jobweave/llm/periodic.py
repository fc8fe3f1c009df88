"""Runs of repeated words: maximal stretches with a small period, found by seed and extension.

A run of period q and length L is a stretch of L - q matches on the diagonal of
lag q, the pairs of words q apart; such a stretch has at least
``max(LEAST - q, q)`` matches. So for lags of one class, from ``LEAST * 2 ** e``
to twice that, every run holds a whole k-gram of ``k = LEAST / 2 * 2 ** e`` words
that starts at a multiple of k, and that k-gram occurs again one lag later. The
k-grams of a document are indexed exactly by doubling; each anchor meets only
the occurrences within its class of lags, at most 2k of them, so a document of n
words has O(n) pairs per class whatever it repeats. A table with the furthest
covered word of each lag suppresses seeds of a stretch that is known already;
the others are extended both ways by whole indexed grams.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import id_and_text, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of the shortest run.
LEAST = 12
#: Pairs of occurrences held at once.
PAIRS = 1 << 18
SCHEMA = (
    "id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
)

#: What a caller does to a document's words before they are searched.
Edit = Callable[[int | None, list[str]], list[str]]


def numbered(words: list[str]) -> np.ndarray:
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    return np.fromiter((index[w] for w in words), np.int64, len(words))


class GramIndex:
    """For each length in ``sizes``, a number per position: equal grams have equal numbers.

    The lengths are 1, 2, 4, 6 and then doubles. Doubling ends at the first
    length that no two positions share, or at ``longest``.
    """

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.n = len(words)
        self.numbers = {1: words}
        for size, first, second in ((2, 1, 1), (4, 2, 2), (LEAST // 2, 4, 2)):
            self._add(size, first, second)
        size = LEAST // 2
        while self.repeats(size) and 2 * size <= min(longest, self.n):
            self._add(2 * size, size, size)
            size *= 2
        self.sizes = sorted(self.numbers, reverse=True)

    def _add(self, size: int, first: int, second: int) -> None:
        places = self.n - size + 1
        if places < 1 or first not in self.numbers or second not in self.numbers:
            return
        left, right = self.numbers[first], self.numbers[second]
        keys = left[:places] * (right.max() + 1) + right[first : first + places]
        self.numbers[size] = np.unique(keys, return_inverse=True)[1]

    def repeats(self, size: int) -> bool:
        numbers = self.numbers.get(size)
        return numbers is not None and int(numbers.max()) + 1 < len(numbers)

    def reach(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words from i on, or before i, equal those from j on, or before j; i < j."""
        total = np.zeros(len(i), np.int64)
        for size in self.sizes:
            numbers = self.numbers[size]
            open_ = np.arange(len(i))
            while len(open_):
                a = i[open_] + total[open_] if ahead else i[open_] - total[open_] - size
                b = j[open_] + total[open_] if ahead else j[open_] - total[open_] - size
                inside = (b < len(numbers)) if ahead else (a >= 0)
                open_, a, b = open_[inside], a[inside], b[inside]
                open_ = open_[numbers[a] == numbers[b]]
                total[open_] += size
                if size != self.sizes[0]:
                    break  # twice this size was refused already
        return total


def seeds(index: GramIndex, size: int, step: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, lags) of equal grams whose lag is at least ``low`` and below ``high``, in blocks of anchors."""
    numbers = index.numbers[size]
    keys = numbers * index.n + np.arange(len(numbers))
    keys.sort()
    anchors = np.arange(0, len(numbers), step)
    base = numbers[anchors] * index.n
    first = np.searchsorted(keys, base + np.minimum(anchors + low, index.n))
    last = np.searchsorted(keys, base + np.minimum(anchors + high, index.n))
    some = last > first
    anchors, first, count = anchors[some], first[some], (last - first)[some]
    ends = np.cumsum(count)
    begin = 0
    while begin < len(anchors):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        n = count[begin:stop]
        before = np.cumsum(n) - n
        place = np.repeat(first[begin:stop] - before, n) + np.arange(n.sum())
        own = np.repeat(anchors[begin:stop], n)
        yield own, keys[place] % index.n - own
        begin = stop


def stretches(index: GramIndex, size: int, step: int, low: int, high: int) -> Iterator[np.ndarray]:
    """Rows (start, matches, lag) of the maximal stretches that a seed of this class lies in."""
    covered = np.full(high - low, -1, np.int64)
    for anchors, lags in seeds(index, size, step, low, high):
        order = np.lexsort((anchors, lags))
        anchors, lags = anchors[order], lags[order]
        # The next anchor's seed on the same lag continues the stretch.
        fresh = np.ones(len(anchors), bool)
        fresh[1:] = (lags[1:] != lags[:-1]) | (anchors[1:] != anchors[:-1] + step)
        fresh &= anchors >= covered[lags - low]
        anchors, lags = anchors[fresh], lags[fresh]
        left = index.reach(anchors, anchors + lags, ahead=False)
        right = index.reach(anchors, anchors + lags, ahead=True)
        np.maximum.at(covered, lags - low, anchors + right)
        yield np.stack([anchors - left, left + right, lags], 1)


def runs(words: list[str]) -> np.ndarray:
    """Rows (start, length, period) by start, then period."""
    n = len(words)
    none = np.zeros((0, 3), np.int64)
    if n < LEAST:
        return none
    index = GramIndex(numbered(words), n // 4)
    found = [none]
    low, size, step = 1, LEAST // 2, 1
    while low <= n // 2 and index.repeats(size):
        high = LEAST if low == 1 else 2 * low
        for start, matches, lag in (s.T for s in stretches(index, size, step, low, high)):
            long = (matches >= np.maximum(LEAST - lag, lag)) & (lag <= n // 2)
            found.append(np.stack([start, matches + lag, lag], 1)[long])
        size = size if low == 1 else 2 * size
        low, step = high, size
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # A multiple of the smallest period covers the very same words.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: list[str], found: np.ndarray) -> str:
    """The words that no run repeats: of each run its first period stays."""
    if not len(found):
        return " ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0))


def _found(edit: Edit | None):
    types = [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in texts(batches):
            counts, listed, kept = [], [], []
            for doc_id, text in zip(ids.to_pylist(), values):
                words = WORD.findall(text)
                if edit:
                    words = edit(doc_id, words)
                found = runs(words)
                counts.append(len(words))
                listed.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                kept.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(listed, types[0]), pa.array(kept, types[1])],
                ["id", "n_words", "runs", "collapsed"],
            )

    return run


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None
) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every row.

    Words are split at blanks and compared as they are. ``runs`` lists every
    stretch (start, length, period) of at least ``max(LEAST, 2 * period)`` words
    with that smallest period which no neighbouring word extends, by start and
    then period; runs may overlap and none is dropped. ``collapsed`` are the
    words, joined by one blank, without those that a run repeats after its first
    period. A null or empty text has no words, no runs and an empty text;
    repeated rows and null ids are searched each time; an empty table gives no
    row; other columns are not read, whatever their names. ``edit`` may change a
    document's words first. Nothing is shuffled: memory per task is one batch of
    texts and, for the longest of them, about a number per word and doubling.
    """
    found = id_and_text(docs, id_col, text_col).mapInArrow(_found(edit), SCHEMA)
    return found.withColumnRenamed("id", id_col)


def longest(runs_col: str = "runs") -> Column:
    """The run of greatest length, or null; ties go to the smallest start, then period."""
    keyed = F.transform(
        runs_col,
        lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")),
    )
    return F.array_max(keyed)
