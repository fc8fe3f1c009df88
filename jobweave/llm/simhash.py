"""Near-duplicate texts by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints that differ in at most ``k`` of 64 bits agree on one of ``k + 1``
blocks of bits. A block with its bits is a node of the index: a mask and the
pattern that its fingerprints share under it. A node that holds more
fingerprints than one task should take is divided again in the same way over
the bits its mask leaves open, so the upper index is spread over the cluster
and a node's size has a bound whatever the data. Inside a node, fingerprints
are sorted by Gray rank, runs of neighbours become lower nodes with the bits
they share, and a shared pattern is factored into the highest node that has it.
A search adds up differences on the way down and leaves a whole group as soon
as they exceed ``k``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import id_and_text, texts
from jobweave.llm.components import connected_components, merge_labels
from jobweave.sources.files import StagedFolder, stage
from jobweave.sources.readers import literal_table

BITS = 64
SEED = 42
ALL = (1 << BITS) - 1
#: Fingerprints of one node that a task searches at once.
NODE_ROWS = 8192
#: Neighbours in Gray order that make a node one level up.
FAN = 8
#: Searches that walk the index side by side.
BLOCK = 128


def fingerprint(text: str, words: int = 3) -> bytes:
    """Eight bytes, most significant first: the majority of each bit over the shingles' hashes."""
    tokens = text.encode("utf-8").lower().split()
    if not tokens:
        return bytes(8)
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    total, count = np.zeros(BITS, np.int64), max(1, len(tokens) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8", count)
    for i in range(0, count, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8)).reshape(-1, BITS)
        total += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * total > count).tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in texts(batches):
            raw = b"".join(fingerprint(t, words) for t in values)
            fp = np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp)], ["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id bigint, fp bigint")


def split_mask(mask: int, parts: int) -> list[int]:
    """``mask`` plus each of ``parts`` near-equal blocks of the bits it leaves open."""
    open_bits = [i for i in range(BITS) if not mask >> i & 1]
    step = [len(open_bits) * p // parts for p in range(parts + 1)]
    return [mask | sum(1 << i for i in open_bits[a:b]) for a, b in zip(step, step[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each code in reflected Gray order: the prefix xor of its bits."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over sorted fingerprints, the finest first.

    A level holds, per node, the pattern its fingerprints share and a residual
    mask: the shared bits that its parent does not share already.
    """

    def __init__(self, sorted_codes: np.ndarray) -> None:
        self.codes = sorted_codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        pattern = sorted_codes
        shared = np.full(len(pattern), ALL, np.uint64)
        while True:
            if len(pattern) <= FAN:
                self.levels.append((pattern, shared))
                break
            starts = np.arange(0, len(pattern), FAN)
            ones = np.bitwise_and.reduceat(pattern & shared, starts)
            zeros = np.bitwise_and.reduceat(~pattern & shared, starts)
            up = ones | zeros
            above = np.repeat(up, FAN)[: len(pattern)]
            self.levels.append((pattern, shared & ~above))
            pattern, shared = ones, up

    def pairs(self, first: int, last: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), i < j, within ``limit`` bits, for searches ``first`` to ``last - 1``."""
        top = len(self.levels[-1][0])
        query = np.repeat(np.arange(first, last), top)
        node = np.tile(np.arange(top), last - first)
        spent = np.zeros(len(query), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, residual = self.levels[depth]
            spent = spent + np.bitwise_count((self.codes[query] ^ pattern[node]) & residual[node])
            span = FAN**depth
            # A node that ends before the searching code only repeats earlier searches.
            keep = (spent <= limit) & ((node + 1) * span > query)
            query, node, spent = query[keep], node[keep], spent[keep]
            if depth:
                size = len(self.levels[depth - 1][0])
                query, spent = np.repeat(query, FAN), np.repeat(spent, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < size
                query, node, spent = query[inside], node[inside], spent[inside]
        later = node > query
        return query[later], node[later]


def link_group(codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, least code of its class) of the codes that a link joins to a lesser one."""
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    labels = np.arange(len(codes))
    index = GrayIndex(codes)
    for first in range(0, len(codes), BLOCK):
        merge_labels(labels, *index.pairs(first, min(first + BLOCK, len(codes)), limit))
    moved = labels != np.arange(len(codes))
    return codes[moved], codes[labels[moved]]


def _linked(limit: int):
    """Stars of links from rows sorted by node; small nodes are searched together."""

    def stars(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        # The commonest node holds two fingerprints; such nodes are compared all at once.
        at = starts[size == 2]
        near = np.bitwise_count(part[at] ^ part[at + 1]) <= limit
        found = [np.stack([part[at + 1][near], part[at][near]])]
        for first, last in zip(starts[size > 2], ends[size > 2]):
            found.append(np.stack(link_group(part[first:last], limit)))
        return np.concatenate(found, axis=1)

    def emit(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        found = stars(rows[2].view(np.uint64), starts, ends).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
            held = np.concatenate([held, rows], axis=1)
            if not held.shape[1]:
                continue
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if not len(change):
                continue
            # The last node may go on in the next batch.
            cut = change[-1]
            yield emit(held[:, :cut], np.r_[0, change[:-1]], change)
            held = held[:, cut:]
        if held.shape[1]:
            yield emit(held, np.array([0]), np.array([held.shape[1]]))

    return run


def fingerprint_links(
    codes: DataFrame, limit: int = 3, node_rows: int = NODE_ROWS
) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``limit`` bits.

    ``codes`` has one column ``fp`` of different fingerprints. Each node gives
    a star per class it finds, so edges never outnumber its rows.
    """
    spark = codes.sparkSession
    folder = StagedFolder(spark, "simhash-nodes")
    masks = [_signed(m) for m in split_mask(0, limit + 1)]
    rows = codes.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    done, level = [], 0
    while True:
        level += 1
        nodes = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")
        crowded = nodes.groupBy("mask", "pattern").count().filter(F.col("count") > node_rows)
        crowded, number = folder.write(crowded.select("mask", "pattern"), f"crowded-{level}")
        open_bits = min(BITS - (m & ALL).bit_count() for m in masks)
        # Different codes that share all but ``open_bits`` bits are 2 ** open_bits at most.
        if not number or 1 << open_bits <= max(node_rows, 1 << (limit + 1)):
            done.append(nodes)
            break
        done.append(nodes.join(crowded, ["mask", "pattern"], "left_anti"))
        children = [(m, _signed(c)) for m in masks for c in split_mask(m & ALL, limit + 1)]
        finer = literal_table(spark, children, "mask bigint, child bigint")
        within = nodes.join(crowded, ["mask", "pattern"], "left_semi")
        rows = within.join(finer, "mask").select("fp", F.col("child").alias("mask"))
        rows, _ = folder.write(rows.distinct(), f"level-{level}")
        masks = sorted({c for _, c in children})
    together = done[0]
    for more in done[1:]:
        together = together.unionAll(more)
    return (
        together.repartition("mask", "pattern")
        .sortWithinPartitions("mask", "pattern", "fp")
        .mapInArrow(_linked(limit), "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    limit: int = 3,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row.

    Two rows are linked when their fingerprints differ in at most ``limit``
    bits; ``component_id`` is the least id reachable over links, its own
    included. Copies meet in one fingerprint before anything is searched.
    A null or blank text has fingerprint zero, linked like any other. A null
    id is never a component's name unless all its members are null. Repeated
    rows come back as often as they came; an empty table gives an empty result.
    Other columns are not read.
    """
    marked = stage(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    codes = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-codes")
    stars = connected_components(fingerprint_links(codes.select("fp"), limit, node_rows))
    named = codes.join(stars, codes["fp"] == stars["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_code = named.join(least, "component").select("fp", "component_id")
    return marked.join(of_code, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` whose id names their component; all columns stay.

    Rows that repeat both id and text stay once. A row without an id cannot be
    told from its copies and stays as it is.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    named = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
