"""What the operators of this subpackage share: naming, batches of texts, hot-safe joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {name.lower() for name in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add itself."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    )


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; null ids have remainder -1."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    digits = column.cast("bigint").cast("string").cast("binary")
    return F.coalesce(F.crc32(digits) % modulus, F.lit(-1))


#: Rows that a task turns into Python objects at once.
SLICE_ROWS = 512


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``SLICE_ROWS`` rows; empty ones are left out."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of parts of an ``id_and_text`` frame's batches; null texts become empty."""
    for part in slices(batches):
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]
