"""Version history in parts: open versions by a hash of their entity, closed ones by the run that closed them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators import history
from jobweave.session import RunClock
from jobweave.sinks.tables import PART, TableSet, run_part
from jobweave.sources.files import StagedFolder

_OPEN = "open"


class VersionTable:
    """The versions of one kind of entity, of which each has one open version.

    A run reads open versions only, replaces the buckets of them that hold a
    changed entity, and adds the versions it closes to a part of its own. Closed
    versions are neither read nor rewritten, so a run costs what the entities and
    their changes cost, however long the history is.
    """

    def __init__(self, tables: TableSet, name: str, buckets: int = 16) -> None:
        self.tables, self.name, self.buckets = tables, name, buckets

    def _open_part(self) -> Column:
        bucket = F.pmod(F.xxhash64("entity_key"), F.lit(self.buckets)).cast("string")
        return F.concat(F.lit(f"{_OPEN}{self.buckets}-"), bucket)

    def _is_dealt(self) -> bool:
        opened = [p for p in self.tables.parts(self.name) if p.startswith(_OPEN)]
        return bool(opened) and all(p.startswith(f"{_OPEN}{self.buckets}-") for p in opened)

    def open_versions(self) -> DataFrame | None:
        """Each entity's version in force; nothing before the first run."""
        if not self.tables.exists(self.name):
            return None
        if not self.tables.parts(self.name):
            return self.tables.read(self.name).filter("valid_to IS NULL")
        return self.tables.stored(self.name).filter(F.col(PART).startswith(_OPEN)).drop(PART)

    def _write_whole(self, rows: DataFrame, closed_by: Column) -> None:
        part = F.when(F.col("valid_to").isNull(), self._open_part()).otherwise(closed_by)
        self.tables.write_parts(self.name, rows.withColumn(PART, part))

    def advance(self, compared: DataFrame, clock: RunClock) -> None:
        """Close the versions of changed entities and open new ones.

        ``compared`` is read several times: stage it. Closed versions are written
        before the open ones are replaced, so none is ever missing. A run that is
        cut short is mended by the same run again. A table that is whole, or has
        another number of buckets, is dealt once.
        """
        new = history.new_versions(compared, clock).withColumn(PART, self._open_part())
        # At most as many values as buckets.
        touched = [r[PART] for r in new.select(PART).distinct().collect()]
        if not self.tables.exists(self.name):
            self.tables.write_parts(self.name, new) if touched else self.tables.write(self.name, new.drop(PART))
            return
        if not touched:
            return
        if not self._is_dealt():
            rows = history.advance_versions(compared, self.tables.read(self.name), clock)
            self._write_whole(rows, run_part(F.lit(None)))
            return
        folder = StagedFolder(self.tables.spark, f"versions-{self.name}")
        opened = self.tables.stored(self.name).filter(F.col(PART).isin(touched))
        met, _ = folder.write(history.close_versions(opened, new, clock), "met")
        closed = met.filter("valid_to IS NOT NULL").drop(PART)
        self.tables.add_to_run(self.name, closed, clock.run_id, ["snapshot_id"])
        self.tables.replace_parts(self.name, met.filter("valid_to IS NULL").unionByName(new))
        folder.remove("met")

    def prune(self, run_date: date, years: int = 5) -> int:
        """Delete versions past retention, keeping each entity's newest; how many. Parts keep their names."""
        rows = self.tables.read(self.name)
        deleted = history.pruned_count(rows, run_date, years).first()["deleted"]
        if deleted and self.tables.parts(self.name):
            kept = history.prune_versions(self.tables.stored(self.name), run_date, years)
            self.tables.write_parts(self.name, kept)
        elif deleted:
            self.tables.write(self.name, history.prune_versions(rows, run_date, years))
        return deleted
