"""Context-triggered piecewise hashing of texts, and the likeness of two such hashes.

A rolling hash over the last seven bytes ends a chunk wherever it hits the
block size's residue, so an edit changes the chunks it touches and no others.
Each chunk gives one character; a signature is the block size with the chunk
characters at that size and at twice it. Signatures are compared by edit
distance (insertions and deletions cost one, a replacement two) at the block
sizes they share.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import id_and_text
from jobweave.sources.readers import literal_table

#: Bytes the rolling hash sees.
WINDOW = 7
LEAST_BLOCK = 3
#: Chunks per signature; what follows them is hashed as one last chunk.
CHUNKS = 64
ALPHABET = np.frombuffer(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8
)
#: Rows a range of ids should hold, and the equal bins of ids that ranges are made of.
RANGE_ROWS = 1000
BINS = 1 << 14


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum, weighted sum and shifted xor of the window."""
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    size = len(data)
    plain, weighted, shifted = (np.zeros(size, np.uint32) for _ in range(3))
    for k in range(WINDOW):
        part = wide[k : k + size]
        plain += part
        weighted += part * np.uint32(k + 1)
        shifted ^= part << np.uint32(5 * (WINDOW - 1 - k))
    return plain + weighted + shifted


def _characters(data: bytes, ends: np.ndarray, limit: int) -> str:
    """One character per chunk; from chunk ``limit`` on the rest is one chunk."""
    cuts = [0, *(ends[: limit - 1] + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    view = memoryview(data)
    low = np.array([zlib.crc32(view[a:b]) & 63 for a, b in zip(cuts, cuts[1:])], np.uint8)
    return ALPHABET[low].tobytes().decode()


def fingerprint(text: str) -> str:
    """block:characters:characters at twice the block; an empty text has no characters."""
    data = text.encode("utf-8")
    roll = rolling(np.frombuffer(data, np.uint8))
    block = LEAST_BLOCK
    while block * CHUNKS < len(data):
        block *= 2
    while True:
        ends = np.flatnonzero(roll % np.uint32(block) == block - 1)
        if block == LEAST_BLOCK or len(ends) >= CHUNKS // 2:
            break
        block //= 2
    double = ends[roll[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_characters(data, ends, CHUNKS)}:{_characters(data, double, CHUNKS // 2)}"


def _padded(marks: list[str]) -> np.ndarray:
    raw = b"".join(m.encode().ljust(CHUNKS, b"\0") for m in marks)
    return np.frombuffer(raw, np.uint8).reshape(-1, CHUNKS)


def common_length(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, 64 positions in one word."""
    one, two, rows = _padded(left), _padded(right), np.arange(len(left))
    known = np.zeros((len(left), 128), np.uint64)
    for at in range(CHUNKS):
        known[rows, one[:, at]] |= np.uint64(1 << at)
    known[:, 0] = 0
    state = np.full(len(left), ~np.uint64(0))
    for at in range(CHUNKS):
        match = state & known[rows, two[:, at]]
        state = (state + match) | (state - match)
    return np.bitwise_count(~state).astype(np.int64)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; 1 for equal ones.

    The edit distance d of two signatures of lengths n and m gives
    1 - d / (n + m). Block sizes b and b are compared at b and 2b, b and 2b at
    the one they share; others share nothing.
    """
    parts_l = [s.split(":") for s in left]
    parts_r = [s.split(":") for s in right]
    best = np.zeros(len(left))
    jobs: list[tuple[int, str, str]] = []
    for i, (a, b) in enumerate(zip(parts_l, parts_r)):
        if a == b:
            best[i] = 1.0
        elif a[0] == b[0]:
            jobs += [(i, a[1], b[1]), (i, a[2], b[2])]
        elif int(a[0]) == 2 * int(b[0]):
            jobs.append((i, a[1], b[2]))
        elif 2 * int(a[0]) == int(b[0]):
            jobs.append((i, a[2], b[1]))
    if jobs:
        at, one, two = zip(*jobs)
        total = np.array([len(a) + len(b) for a, b in zip(one, two)])
        value = 2 * common_length(list(one), list(two)) / np.maximum(total, 1)
        np.maximum.at(best, np.array(at), value)
    return best


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


OUT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the next; the last row of a range is only looked at."""
    names = [field.split()[0] for field in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held, current = None, None
    for batch in batches:
        rows: list[tuple] = []
        following: list[str] = []
        columns = (batch.column(c).to_pylist() for c in ("range", "id", "text", "ahead"))
        for number, doc_id, text, ahead in zip(*columns):
            if number != current:
                held, current = None, number
            elif held is None:
                continue  # the range has ended; more rows share the first id of the next one
            mark = fingerprint(text)
            if held is not None:
                old_id, old_text, old_mark = held
                changed = edited(old_text, text)
                digest = hashlib.sha256(changed.encode("utf-8")).hexdigest()
                new_mark = old_mark if changed == old_text else fingerprint(changed)
                rows.append((old_id, len(old_text), digest, old_mark, new_mark))
                following.append(mark)
            held = None if ahead else (doc_id, text, mark)
        if rows:
            marks = [r[3] for r in rows]
            near = [likeness(marks, [r[4] for r in rows]), likeness(marks, following)]
            arrays = [pa.array(c, t) for c, t in zip([*zip(*rows), *near], types)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _with_ranges(rows: DataFrame, range_rows: int) -> DataFrame:
    """``rows`` with the range of each and, for the first id of a range, the range before it.

    Ids fall into ``BINS`` equal bins, whose counts become ranges of about
    ``range_rows`` rows, numbered from 0 without gaps; null ids come first. The
    counts, ``BINS`` rows at most, are all that reaches the driver or is sent to
    the executors.
    """
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    low, high = low or 0, high or 0
    share = (F.col("id").cast("double") - float(low)) / (float(high) - float(low) + 1.0)
    slot = F.when(F.col("id").isNull(), 0).otherwise(
        F.least(F.floor(share * (BINS - 1)) + 1, F.lit(BINS - 1))
    )
    marked = rows.withColumn("slot", slot.cast("int"))
    counted = marked.groupBy("slot").agg(F.count(F.lit(1)), F.min("id")).collect()
    known, taken = [], range_rows
    for at, size, least in sorted(counted, key=lambda row: row[0]):
        begins = taken >= range_rows
        taken = size + (0 if begins else taken)
        known.append((at, (known[-1][1] if known else -1) + begins, begins, least))
    last = known[-1][1] if known else 0
    table = [
        (at, number, (number - 1 if number else last) if begins else None, least)
        for at, number, begins, least in known
    ]
    bins = literal_table(rows.sparkSession, table, "slot int, range int, before int, least bigint")
    first = F.when(F.col("id").eqNullSafe(F.col("least")), F.col("before"))
    return marked.join(F.broadcast(bins), "slot").withColumn("before", first).drop("slot", "least")


def fingerprint_neighbours(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. Rows are in order of id, equal ids in order of
    their texts, null ids first; the last row is followed by the first. A null
    text is empty. Repeated rows follow each other; a single row follows
    itself; an empty table gives an empty result. Other columns are not read.

    Rows are dealt by ranges of ids, so a text moves once; the first row of a
    range is also sent to the range before it.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    own = F.struct("range", F.lit(False).alias("ahead"))
    again = F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))
    to = F.when(F.col("before").isNotNull(), F.array(own, again)).otherwise(F.array(own))
    return (
        _with_ranges(rows, range_rows)
        .select("id", "text", F.explode(to).alias("to"))
        .select("to.range", "to.ahead", "id", "text")
        .repartition("range")
        .sortWithinPartitions("range", "ahead", F.col("id").asc_nulls_first(), "text")
        .mapInArrow(_compared, OUT)
        .withColumnRenamed("id", id_col)
    )
