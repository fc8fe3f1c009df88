"""The load-run log and the summary of one load."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.upsert import Merge, collapse
from jobweave.session import RunClock, _utc_now
from jobweave.sinks.tables import TableSet
from jobweave.sources.readers import literal_table

RUN_TABLE = "load_run"
_SCHEMA = (
    "run_id string, kind string, loader string, source string, started_at timestamp, "
    "status string, completed_at timestamp, rows_processed bigint, rows_rejected bigint"
)
_SUMMARY = (
    "loader string, run_id string, started_at string, completed_at string, "
    "rows_processed bigint, rows_rejected bigint, rows_unmatched bigint, "
    "edges_unmatched bigint, status string"
)


@dataclass
class LoadSummary:
    """Accepted, rejected and unmatched counts of one load; an unmatched edge's row is in other tables."""

    loader: str
    run_id: str
    started_at: str
    completed_at: str | None = None
    rows_processed: int = 0
    rows_rejected: int = 0
    rows_unmatched: int = 0
    edges_unmatched: int = 0
    status: str = "STARTED"

    def as_dict(self) -> dict:
        return asdict(self)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, [tuple(self.as_dict().values())], _SUMMARY)


class RunLog:
    """Opens a run before a load and closes it with counts and a status.

    Each step appends one row; nothing is rewritten, so loads running at the
    same time do not disturb each other's log.
    """

    def __init__(self, tables: TableSet) -> None:
        self.spark = tables.spark
        self.path = f"{tables.root}/{RUN_TABLE}/steps"

    def _append(self, row: tuple) -> None:
        literal_table(self.spark, [row], _SCHEMA).write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        """One row per run: how it was opened, and its latest status and counts."""
        steps = self.spark.read.schema(_SCHEMA).parquet(self.path)
        closing = F.col("completed_at").isNotNull()
        merge = Merge(
            keys=("run_id",),
            set_columns=("status",),
            keep_old=(
                "kind", "loader", "source", "started_at", "completed_at", "rows_processed",
                "rows_rejected",
            ),
        )
        return collapse(steps.withColumn("_seq", closing), merge).select(*steps.columns)

    def open(self, clock: RunClock, loader: str, source: str) -> LoadSummary:
        started = _as_datetime(clock.loaded_at)
        self._append(
            (clock.run_id, "load", loader, source, started, "STARTED", None, None, None)
        )
        return LoadSummary(loader, clock.run_id, clock.loaded_at)

    def close(self, summary: LoadSummary, status: str) -> LoadSummary:
        summary.status = status
        summary.completed_at = _utc_now()
        self._append(
            (
                summary.run_id, None, None, None, None, status,
                _as_datetime(summary.completed_at), summary.rows_processed, summary.rows_rejected,
            )
        )
        return summary


def _as_datetime(text: str) -> datetime:
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc)
