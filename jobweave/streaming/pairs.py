"""Data and control files paired as they arrive.

A half waits for the other one in the state of a stream-stream outer join. The
watermark of the event time, which is one of the keys, bounds that state: once
it has passed a half's time, the half is released without its partner.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobweave.operators.extras import checked_pairs, half


def pair_stream(
    data: DataFrame, control: DataFrame, keys: Sequence[str], time: str, delay: str, checks: Mapping[str, Column]
) -> DataFrame:
    """What ``pair_checks`` gives, as a stream of two streams.

    ``time`` is one of the ``keys``, a timestamp that both halves carry; a half
    more than ``delay`` behind the latest one of both streams may find its
    partner gone. Each half must be unique by its keys, as for ``pair_checks``.
    Rows whose key or time is null have no partner and no time to wait for, and
    come with neither.
    """
    if time not in keys:
        raise ValueError("the event time must be one of the keys")
    left = half(data.withWatermark(time, delay), keys, "data")
    right = half(control.withWatermark(time, delay), keys, "control")
    right = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_other_{k}") for k in keys]
    joined = left.join(right, same, "full_outer")
    either = {k: F.coalesce(k, f"_other_{k}") for k in keys}
    return checked_pairs(joined.withColumns(either), keys, checks)


def append_pairs(pairs: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append pairs to a parquet folder as they are made or released; a restart goes on from the checkpoint."""
    writer = pairs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(folder)
