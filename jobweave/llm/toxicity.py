"""Toxicity by two class-conditional Kneser-Ney character models.

Each class has its own counts of character n-grams of the two longest orders; below
them both back off to one set of continuation counts pooled over the classes, so an expression that a class has
hardly seen is smoothed alike in both and does not speak for either. A text is
judged by the difference of its log-likelihoods per character.

Characters are folded to ``SYMBOLS`` classes, so a model has
``SYMBOLS ** order`` cells per class whatever the corpus: the counts cover all
training rows, and what is sent to the executors has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import id_and_text, remainder, slices
from jobweave.sources.files import stage

SYMBOLS = 32
ORDER = 4
DISCOUNT = 0.75
#: Neutral characters added to each text's length, so a few letters decide nothing.
PAD = 100
#: Parts of the training rows; each is scored by a model of the others to place the threshold.
PARTS = 4
#: What a missed toxic text costs, in false alarms.
MISSED = 2
#: Cells of the histogram from which the threshold is read, and their width.
BINS, STEP = 4001, 0.0005


def symbols(text: str) -> np.ndarray:
    """Letters a-z are 1-26, other scripts 27-31, all else 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    ascii_letter = (points >= 97) & (points <= 122)
    return np.where(ascii_letter, points - 96, np.where(points > 127, 27 + points % 5, 0)).astype(np.int32)


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """The index of the n-gram that ends at each character."""
    padded = np.concatenate([np.zeros(order - 1, np.int32), symbols(text)])
    size = len(padded) - order + 1
    index = padded[:size].copy()
    for k in range(1, order):
        index *= SYMBOLS
        index += padded[k : k + size]
    return index


def shared_backoff(counts: np.ndarray, order: int, discount: float = DISCOUNT) -> np.ndarray:
    """P(last character | order - 3 before it) from continuation counts pooled over the classes."""
    continued, tables = counts.sum(0), []
    for _ in range(order - 1):
        continued = (continued > 0).reshape(SYMBOLS, -1).sum(0)
        tables.append(continued)
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for table in reversed(tables[1:]):
        lower = _smoothed(table, lower, discount)
    return lower


def class_model(counts: np.ndarray, shared: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """P(last character | order - 1 before it) of one class, over its own shorter n-grams."""
    shorter = counts.reshape(SYMBOLS, -1).sum(0)
    return _smoothed(counts, _smoothed(shorter, shared, discount), discount)


def _smoothed(table: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
    rows = table.reshape(-1, SYMBOLS).astype(float)
    backoff = np.resize(lower.reshape(-1, SYMBOLS), rows.shape)
    total = rows.sum(1, keepdims=True)
    weight = discount * (rows > 0).sum(1, keepdims=True)
    known = (np.maximum(rows - discount, 0) + weight * backoff) / np.maximum(total, 1)
    return np.where(total > 0, known, backoff).ravel()


@dataclass(frozen=True)
class ToxicityModel:
    """The log-ratio that each n-gram adds."""

    ratio: np.ndarray
    order: int

    @classmethod
    def from_counts(cls, counts: np.ndarray, order: int) -> ToxicityModel:
        """``counts`` has one row per class (0, 1). Without both classes nothing is toxic."""
        if not counts.any(axis=1).all():
            return cls(np.zeros(counts.shape[1], np.float32), order)
        shared = shared_backoff(counts, order)
        ordinary, toxic = (np.log(class_model(c, shared)) for c in counts)
        return cls((toxic - ordinary).astype(np.float32), order)

    def log_ratio(self, index: np.ndarray) -> float:
        """Of a text given by the n-grams that end at its characters."""
        return float(self.ratio[index].sum(dtype=np.float64) / (len(index) + PAD))


def gram_counts(labelled: DataFrame, order: int = ORDER) -> np.ndarray:
    """Counts per part and class over all rows of (part, text, toxic); the result has a fixed size."""
    cells = SYMBOLS**order

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2 * PARTS, cells), np.uint32)
        for batch in slices(batches):
            for part, text, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    np.add.at(table[2 * part + toxic], grams(text, order), 1)
        for cell, counted in enumerate(table):
            seen = np.flatnonzero(counted)
            columns = [np.full(len(seen), cell, np.int32), seen.astype(np.int32), counted[seen].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "gram", "n"])

    partial = labelled.select("part", "text", "toxic").mapInArrow(run, "cell int, gram int, n bigint")
    # At most 2 * PARTS * SYMBOLS ** order rows.
    total = partial.groupBy("cell", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2 * PARTS, cells))
    counts[total["cell"], total["gram"]] = total["n"]
    return counts.reshape(PARTS, 2, cells)


def log_ratios(
    docs: DataFrame, id_col: str, text_col: str, part: Column, model: ToxicityModel, others: list[ToxicityModel]
) -> DataFrame:
    """(id, ratio, crossed) of every row; ``crossed`` is under the model of the other parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                index = grams(text or "", model.order)
                found.append((model.log_ratio(index), others[own].log_ratio(index)))
            columns = [batch.column(0), *(pa.array(c, pa.float64()) for c in zip(*found))]
            if found:
                yield pa.RecordBatch.from_arrays(columns, ["id", "ratio", "crossed"])

    rows = id_and_text(docs, id_col, text_col).withColumn("part", part)
    return rows.mapInArrow(run, "id bigint, ratio double, crossed double")


def threshold(histogram: np.ndarray) -> tuple[float, float]:
    """(threshold, slope) from counts per bin of ordinary and toxic training rows.

    The threshold costs least, a missed toxic row counting ``MISSED`` times a
    false alarm; where a range of values does, it is the middle. The slope then
    maximises the likelihood of a logistic curve.
    """
    ordinary, toxic = histogram
    if not ordinary.sum() or not toxic.sum():
        return STEP * BINS, 1.0
    wrong = np.concatenate([[0], MISSED * np.cumsum(toxic)]) + np.concatenate([np.cumsum(ordinary[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    # Bins below the boundary are called ordinary.
    run = best[: 1 + np.argmax(np.append(np.diff(best) > 1, True))]
    edge = (run[0] + run[-1]) / 2
    at = (edge - BINS // 2) * STEP
    centre = (np.arange(BINS) + 0.5 - BINS // 2) * STEP
    slopes = np.geomspace(1, 2000, 60)
    loss = [
        (toxic * np.logaddexp(0, -a * (centre - at)) + ordinary * np.logaddexp(0, a * (centre - at))).sum()
        for a in slopes
    ]
    return float(at), float(slopes[int(np.argmin(loss))])


@dataclass(frozen=True)
class Judge:
    """A fitted model with the threshold and slope of its score."""

    model: ToxicityModel
    at: float
    slope: float

    def score(self, ratio: Column) -> Column:
        return 1 / (1 + F.exp(F.lit(-self.slope) * (ratio - F.lit(self.at))))

    def toxic(self, text: str | None) -> bool:
        return self.model.log_ratio(grams(text or "", self.model.order)) >= self.at


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: int, held: int, order: int
) -> tuple[Judge, DataFrame]:
    """The judge of the training rows, and (id, ratio) of every row of ``docs``."""
    known = (
        labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & (remainder("id", fold) != held))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        # The labels grow with the corpus, so no size of theirs may switch to a broadcast.
        .hint("merge")
    )
    part = F.pmod(remainder("id", fold), F.lit(PARTS)).cast("int")
    learnable = id_and_text(docs, id_col, text_col).filter(remainder("id", fold) != held)
    counts = gram_counts(learnable.withColumn("part", part).join(known, "id"), order)
    whole = counts.sum(0)
    model = ToxicityModel.from_counts(whole, order)
    others = [ToxicityModel.from_counts(whole - c, order) for c in counts]
    ratios = stage(log_ratios(docs, id_col, text_col, part, model, others), "toxicity-ratios")
    cell = F.least(F.greatest(F.floor(F.col("crossed") / STEP) + BINS // 2, F.lit(0)), F.lit(BINS - 1))
    # At most 2 * BINS rows.
    spread = ratios.join(known, "id").groupBy("toxic", cell.alias("cell")).count().toPandas()
    histogram = np.zeros((2, BINS))
    histogram[spread["toxic"], spread["cell"]] = spread["count"]
    return Judge(model, *threshold(histogram)), ratios


def label_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fold: int = 5,
    held: int = 0,
    order: int = ORDER,
) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of ``docs``.

    Labels are learnt only from rows whose crc32(id) modulo ``fold`` is not
    ``held``; an id with several labels has the largest. ``score`` is 0 to 1,
    ``predicted`` is 1 from 0.5 on. A null or empty text scores as a text
    without evidence; a null id is never learnt from and never held out.
    Repeated rows are scored each time. Without training rows of both classes
    nothing is predicted toxic. Other columns of either table are not read.
    """
    judge, ratios = fit(docs, labels, id_col, text_col, label_col, fold, held, order)
    score = judge.score(F.col("ratio"))
    return ratios.select(
        F.col("id").alias(id_col),
        (remainder("id", fold) == held).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fold: int = 5,
    held: int = 0,
    order: int = ORDER,
) -> DataFrame:
    """The rows of ``docs`` whose own text is not predicted toxic, all columns kept.

    Every row is judged by itself, so nothing is joined: null and repeated ids
    are filtered like others, and equal texts share their fate. Null and empty
    texts stay. Repeated rows stay as often as they came; an empty table, or one
    without training rows of both classes, comes back as it is.
    """
    judge, _ = fit(docs, labels, id_col, text_col, label_col, fold, held, order)
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = batch.column(place).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([not judge.toxic(t) for t in values], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
