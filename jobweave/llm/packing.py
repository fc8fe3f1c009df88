"""Sum-of-squares online packing of token sequences into fixed windows.

Each task packs the rows of its own input split as they come: nothing is
shuffled, whatever the size of the corpus, and a lost task packs the same rows
again. A level array counts the partially filled windows of each fill level; a
document goes where the sum of the squared counts grows least.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import id_and_text, texts
from jobweave.llm.tokens import ByteTokenizer

WINDOW = 1024
END = 0
#: Sequences of different tasks are numbered this far apart.
STRIDE = 1 << 40
OUT_ROWS = 256
SCHEMA = (
    "id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ids binary"
)

#: (document number, first id within the document, number of ids)
Piece = tuple[int, int, int]


class SumOfSquares:
    """Open windows by fill level; ``place`` returns the windows it fills."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """The level to add ``size`` ids to; 0 opens a window. The fullest wins a tie.

        Moving a window from level h to h + size changes the sum of squares by
        2 (N[h + size] - N[h] + 1), where an empty or a full window counts nothing.
        """
        top = self.window - size
        grown = 2 * self.count[size : self.window + 1] + 1
        grown[top] = 0
        left = 1 - 2 * self.count[: top + 1]
        left[0] = 0
        cost = grown + left
        usable = self.count[: top + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def place(self, document: int, tokens: int) -> Iterator[list[Piece]]:
        """Whole windows of a long document stand alone; its rest joins a level."""
        start = 0
        while tokens - start >= self.window:
            yield [(document, start, self.window)]
            start += self.window
        size = tokens - start
        if not size:
            return
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        else:
            pieces = []
        pieces.append((document, start, size))
        if level + size == self.window:
            yield pieces
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.count[level + size] += 1

    def flush(self) -> Iterator[list[Piece]]:
        """Close what is open: the emptiest windows fill the fullest, cut where needed."""
        rest = [pieces for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        first, last = 0, len(rest) - 1
        while first <= last:
            pieces = rest[first]
            space = self.window - sum(n for _, _, n in pieces)
            while space and first < last:
                document, start, size = rest[last].pop()
                part = min(size, space)
                # The end of the piece moves, so its beginning stays where it is.
                pieces.append((document, start + size - part, part))
                space -= part
                if part < size:
                    rest[last].append((document, start, size - part))
                if not rest[last]:
                    last -= 1
            yield pieces
            first += 1
        self.open.clear()
        self.count[:] = 0


def _packed(tokenizer_path: str, window: int, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer.shared(tokenizer_path)
        number = TaskContext.get().partitionId() * STRIDE
        packer, held, rows = SumOfSquares(window), {}, []
        seen = 0

        def close(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for document, start, size in pieces:
                doc_id, ids, left = held[document]
                rows.append(
                    (doc_id, start, size, len(ids), number, offset, ids[start : start + size].tobytes())
                )
                offset += size
                held[document][2] = left - size
                if left == size:
                    del held[document]
            number += 1

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.binary()])]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                columns, ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            )

        for doc_ids, values in texts(batches):
            for doc_id, text in zip(doc_ids.to_pylist(), values):
                ids = np.append(tokenizer.encode(text), np.uint32(end)).astype("<u4")
                held[seen] = [doc_id, ids, len(ids)]
                for pieces in packer.place(seen, len(ids)):
                    close(pieces)
                seen += 1
                if len(rows) >= OUT_ROWS:
                    yield batch()
        for pieces in packer.flush():
            close(pieces)
            if len(rows) >= OUT_ROWS:
                yield batch()
        if rows:
            yield batch()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    end: int = END,
) -> DataFrame:
    """One row per piece: (id_col, start, length, doc_tokens, sequence_id, offset, ids).

    A document's ids are its tokens and then ``end``; ``ids`` holds those of
    the piece, four bytes each, least significant first. Each id lies in
    exactly one piece. A null or empty text gives the single id ``end``.
    Repeated rows and null ids are documents of their own; an empty table gives
    no piece. Other columns are not read. Memory per task: one batch of texts
    and the open windows.
    """
    path = tokenizer_path or ByteTokenizer.default_path()
    pieces = id_and_text(docs, id_col, text_col).mapInArrow(_packed(path, window, end), SCHEMA)
    return pieces.withColumnRenamed("id", id_col)


def with_digest(pieces: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The crc32 of each piece's ids, beside the ids or in their place."""
    marked = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return marked if keep_ids else marked.drop("ids")
