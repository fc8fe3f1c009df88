"""Merges applied to a stream, one micro-batch at a time.

A merge compares the order of a row with that of the rows already there, so
late files and batches replayed after a failure leave the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from jobweave.operators.upsert import Merge, collapse_ordered
from jobweave.plans.loads import Load, run_load
from jobweave.session import RunClock
from jobweave.sinks.tables import TableSet
from jobweave.sources.files import stage


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is explicit."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def in_time(stream: DataFrame, time: str, delay: str, unique: Sequence[str]) -> DataFrame:
    """Rows at most ``delay`` behind the latest one, each key once within that time.

    The watermark bounds the state that tells repeated rows; a row further
    behind is dropped, and Spark counts it in the query's progress.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(unique))


def merge_stream(
    stream: DataFrame,
    tables: TableSet,
    name: str,
    merge: Merge,
    checkpoint: str,
    seq: str = "_seq",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Merge every micro-batch into one table; ``once`` drains what is available.

    The table keeps the order of what it holds, so late and repeated rows give
    what one batch of all rows gives; read it through ``without_order``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        # Written once, the batch has a known size, so its join can be a broadcast.
        changes = stage(collapse_ordered(rows, merge, seq), f"batch-{name}")
        tables.merge(name, changes, merge, collapsed=True, small=True, ordered=True)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def load_stream(
    stream: DataFrame, tables: TableSet, load: Load, checkpoint: str, once: bool = True,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """A registered load fed by a stream: checks, rejects and merges per micro-batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        # A replayed micro-batch is the same run: its edges and kept rows are replaced.
        run = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{checkpoint}/{batch_id}"))
        run_load(load, prepare(batch) if prepare else batch, tables, RunClock(run), "stream")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
