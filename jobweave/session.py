"""Session settings and the fixed run clock every load shares."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Adaptive execution splits hot join keys and re-plans joins from real sizes;
# everything else keeps the cluster's own settings.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "jobweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


@dataclass(frozen=True)
class RunClock:
    """One run's identity and time, fixed before any plan is built.

    Plans never call ``current_date``: a re-run with the same clock gives the
    same rows.
    """

    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    loaded_at: str = field(default_factory=_utc_now)

    @property
    def run_date(self) -> date:
        return datetime.strptime(self.loaded_at, "%Y-%m-%d %H:%M:%S").date()

    def timestamp(self) -> Column:
        return F.lit(self.loaded_at).cast("timestamp")

    def day(self) -> Column:
        return F.lit(self.run_date)
