"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams. Weights are trained
online with the follow-the-regularised-leader rule under an elastic-net
penalty, which leaves most of them exactly zero; a temperature fitted on rows
kept aside calibrates the probabilities.

Document frequencies cover all training rows. The weights are fitted on a
bounded sample: ``SAMPLE_ROWS`` rows per language, least hashes first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import id_and_text, remainder, slices, texts

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: Sampled training rows per language, and how many of them fit the temperature.
SAMPLE_ROWS, CALIBRATE_EVERY = 400, 5
EPOCHS = 3
#: Step size, its offset, and the penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNDETERMINED = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, damped counts) of a text's n-grams, lower-cased, between two blanks."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for order in ORDERS:
        if len(points) < order:
            break
        size = len(points) - order + 1
        mixed = np.full(size, order, np.uint32)
        for k in range(order):
            mixed = (mixed ^ points[k : k + size]) * _MIX[k]
            mixed ^= mixed >> np.uint32(15)
        counts += np.bincount(mixed >> np.uint32(32 - BITS), minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    return seen, np.log1p(counts[seen])


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default=None)
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        seen, weight = features(text)
        weight = weight * self.idf[seen]
        return seen, weight / max(np.sqrt(weight @ weight), 1e-12)

    def logits(self, seen: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return weight @ self.weights[seen] / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        logits = self.logits(*self.vector(text))
        odds = np.exp(logits - logits.max())
        best = int(np.argmax(odds))
        return self.languages[best], float(odds[best] / odds.sum())

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """Examples in a fixed order; every ``CALIBRATE_EVERY``-th only sets the temperature."""
        classes = len(self.languages)
        z = np.zeros((BUCKETS, classes))
        n = np.zeros((BUCKETS, classes))

        def lead(at: np.ndarray) -> np.ndarray:
            pull = z[at]
            shrunk = np.sign(pull) * np.maximum(np.abs(pull) - L1, 0)
            return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

        learn = [e for i, e in enumerate(examples) if i % CALIBRATE_EVERY]
        aside = [e for i, e in enumerate(examples) if not i % CALIBRATE_EVERY] or learn
        for _ in range(EPOCHS):
            for seen, weight, label in learn:
                w = lead(seen)
                logits = weight @ w
                odds = np.exp(logits - logits.max())
                odds /= odds.sum()
                odds[label] -= 1
                gradient = weight[:, None] * odds
                squared = gradient * gradient
                sigma = (np.sqrt(n[seen] + squared) - np.sqrt(n[seen])) / ALPHA
                z[seen] += gradient - sigma * w
                n[seen] += squared
        self.weights = lead(np.arange(BUCKETS))
        scored = [(weight @ self.weights[seen], label) for seen, weight, label in aside]
        if scored:
            logits, labels = np.array([s for s, _ in scored]), np.array([y for _, y in scored])
            grid = np.geomspace(0.05, 5, 60)
            self.temperature = float(grid[int(np.argmin([_loss(logits / t, labels) for t in grid]))])


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    top = logits.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logits - top).sum(1))
    return float((total - logits[np.arange(len(labels)), labels]).mean())


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(rows that hold each bucket, rows) over all rows of (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = np.zeros(BUCKETS + 1, np.int64), 0
        for _, values in texts(batches):
            total += len(values)
            for text in values:
                table[features(text)[0]] += 1
        table[BUCKETS] = total
        seen = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(table[seen])], ["bucket", "n"]
        )

    partial = rows.mapInArrow(run, "bucket int, n bigint")
    # At most BUCKETS + 1 rows.
    total = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(BUCKETS + 1)
    table[total["bucket"]] = total["n"]
    return table[:BUCKETS], int(table[BUCKETS])


def _sampled(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable, rows: int
) -> DataFrame:
    """Features of ``rows`` rows per language. Ids are drawn first, so few texts are read."""
    narrow = docs.filter(usable).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).alias("lang")
    )
    # Ids, not rows: a row that repeats a thousand times must not thin out the others.
    sizes = narrow.groupBy("lang").agg(F.approx_count_distinct("id").alias("size"))
    mix = F.xxhash64(F.lit("language"), "id")
    first = Window.partitionBy("lang").orderBy(mix, "id")
    # About twice the rows wanted pass, so that a common language is not ranked whole in one task.
    # One row per language is sent to all tasks, less than the drawn ids that follow.
    share = F.pmod(mix, F.lit(1 << 31)) / (1 << 31)
    passed = narrow.join(F.broadcast(sizes), "lang").filter(share * F.col("size") <= 2.0 * rows).select("id", "lang")
    drawn = passed.distinct().withColumn("at", F.row_number().over(first)).filter(F.col("at") <= rows)
    chosen = (
        docs.filter(usable)
        .select(
            F.col(id_col).cast("bigint").alias("id"),
            F.col(text_col).cast("string").alias("text"),
            F.col(lang_col).alias("lang"),
        )
        .join(F.broadcast(drawn), ["id", "lang"])
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("at"),
                    batch.column("lang"),
                    pa.array([a.astype("<i4").tobytes() for a, _ in pairs], pa.binary()),
                    pa.array([w.astype("<f4").tobytes() for _, w in pairs], pa.binary()),
                ],
                ["at", "lang", "seen", "weight"],
            )

    found = chosen.mapInArrow(run, "at int, lang string, seen binary, weight binary")
    # Rows that repeat an id and its language count once, so their number has no say in what is collected.
    least = F.min(F.struct("seen", "weight")).alias("least")
    return found.groupBy("at", "lang").agg(least).select("at", "lang", "least.seen", "least.weight")


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fold: int = 4,
    held: int = 2,
    sample_rows: int = SAMPLE_ROWS,
) -> LanguageModel:
    """A model of the training rows: those with a language whose crc32(id) mod ``fold`` is not ``held``.

    The driver receives the document frequencies (``BUCKETS`` numbers) and the
    features of ``sample_rows`` rows per language (``BUCKETS`` numbers each at
    most); both are bounded.
    """
    usable = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
    usable = usable & (remainder(id_col, fold) != held)
    frequency, total = document_frequencies(id_and_text(docs.filter(usable), id_col, text_col))
    idf = np.log((1 + total) / (1 + frequency)) + 1
    sample = _sampled(docs, id_col, text_col, lang_col, usable, sample_rows).toPandas()
    sample = sample.sort_values(["at", "lang", "seen"], kind="stable")
    model = LanguageModel(sorted(set(sample["lang"])), idf)
    number = {name: i for i, name in enumerate(model.languages)}
    examples = []
    for lang, seen, weight in zip(sample["lang"], sample["seen"], sample["weight"]):
        seen = np.frombuffer(seen, "<i4")
        weight = np.frombuffer(weight, "<f4") * idf[seen]
        examples.append((seen, weight / max(np.sqrt(weight @ weight), 1e-12), number[lang]))
    if examples:
        model.fit(examples)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row.

    A text that is null or has no letter, or any text under a model without
    languages, is ``und`` with score 0. Null ids and repeated rows come back as
    they are; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in texts(batches):
            found = [model.predict(t) for t in values]
            columns = [ids, pa.array([k for k, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score"])

    found = id_and_text(docs, id_col, text_col).mapInArrow(run, "id bigint, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def drop_unidentified(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = 0.5
) -> DataFrame:
    """The rows whose language is determined with ``least_score`` or more; all columns stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([k != UNDETERMINED and p >= least_score for k, p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
