"""Versioned parquet tables, whole or dealt into parts that a merge replaces one by one.

``root/<table>/version=<n>`` is complete once Spark has left its success
marker; the newest complete version is the table. An interrupted write leaves
a folder without a marker, which readers ignore.

A dealt table has a part per hash bucket of its keys, or per run for rows keyed
by one. A merge reads and replaces only the parts its batch touches, in the
current version; the files of all others stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobweave.operators.upsert import Merge, collapse, collapse_ordered, order_columns, upsert, upsert_ordered
from jobweave.sources.files import StagedFolder, child_names, path_exists
from jobweave.sources.readers import SEQ

_VERSION = re.compile(r"^version=(\d+)$")
PART = "_part"
RUN = "run_id"


def bucket_part(keys: tuple[str, ...], buckets: int) -> Column:
    """The part of a row by the hash of its keys."""
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))


def run_part(run: Column) -> Column:
    """The part of a run, a name that is a safe folder whatever the run is called."""
    return F.concat(F.lit("r"), F.sha1(F.coalesce(run.cast("string"), F.lit("")).cast("binary")))


def run_name(run_id: str) -> str:
    """The name that :func:`run_part` gives to a run."""
    return f"r{hashlib.sha1(run_id.encode()).hexdigest()}"


def one_part(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows of a single part hold it as a constant, so that no task sorts them by it to write them."""
    return df.withColumn(PART, F.lit(parts[0])) if len(parts) == 1 else df


class TableSet:
    """Named tables below one root folder.

    ``buckets`` names tables dealt by their keys and their number of buckets:
    choose it so that a bucket is a few files at most. Tables whose keys hold a
    run are dealt by run without being named.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: Mapping[str, int] | None = None) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = dict(buckets or {})
        # Schemas of versions written here, so reading them back infers nothing.
        self._schemas: dict[str, StructType] = {}

    def _versions(self, name: str) -> list[int]:
        found = (_VERSION.match(child) for child in child_names(self.spark, f"{self.root}/{name}"))
        return sorted(int(m.group(1)) for m in found if m)

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/version={version:06d}"

    def current_version(self, name: str) -> int | None:
        for version in reversed(self._versions(name)):
            if path_exists(self.spark, f"{self._folder(name, version)}/_SUCCESS"):
                return version
        return None

    def names(self) -> list[str]:
        return sorted(n for n in child_names(self.spark, self.root) if self.exists(n))

    def exists(self, name: str) -> bool:
        return self.current_version(name) is not None

    def read(self, name: str) -> DataFrame:
        version = self.current_version(name)
        if version is None:
            raise FileNotFoundError(f"no table {name!r} under {self.root}")
        return self._scan(self._folder(name, version))

    def _scan(self, folder: str) -> DataFrame:
        reader = self.spark.read
        if folder in self._schemas:
            reader = reader.schema(self._schemas[folder])
        return reader.parquet(folder).drop(PART)

    def _is_dealt(self, folder: str) -> bool:
        return any(child.startswith(f"{PART}=") for child in child_names(self.spark, folder))

    def _next(self, name: str) -> str:
        return self._folder(name, max(self._versions(name), default=0) + 1)

    def read_or_none(self, name: str) -> DataFrame | None:
        return self.read(name) if self.exists(name) else None

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write the next version and return it as the new current table.

        A table has one writer at a time: a version that is there already fails the
        write, but two writers that start together are not kept apart.
        """
        folder = self._next(name)
        df.write.parquet(folder)
        self._schemas[folder] = df.schema
        return self._scan(folder)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """The current rows plus new ones, as the next version."""
        current = self.read_or_none(name)
        return self.write(
            name, df if current is None else current.unionByName(df, allowMissingColumns=True)
        )

    def merge(
        self, name: str, batch: DataFrame, merge: Merge, seq: str = SEQ, collapsed: bool = False,
        small: bool = False, ordered: bool = False,
    ) -> None:
        """Merge a batch into a table, as ``upsert`` or, if ``ordered``, ``upsert_ordered`` would.

        A dealt table's new parts are staged and then replace the old ones by
        dynamic partition overwrite. They are replaced one after the other, so a
        write that is cut short is mended by merging the same batch again, which
        changes nothing elsewhere. The first merge into a table that is not
        dealt yet, and one that brings new columns, writes a whole version. A
        batch without rows changes nothing.
        """
        fold, combine = (collapse_ordered, upsert_ordered) if ordered else (collapse, upsert)
        if name in self.buckets:
            part = bucket_part(merge.keys, self.buckets[name])
        elif RUN in merge.keys:
            part = run_part(F.col(RUN))
        else:
            current = self.read_or_none(name)
            self.write(name, combine(current, batch, merge, seq, collapsed, small))
            return
        folder = StagedFolder(self.spark, f"merge-{name}")
        columns = [*merge.columns, *(order_columns(merge) if ordered else ())]
        changes = batch.select(*columns) if collapsed else fold(batch, merge, seq)
        changes, rows = folder.write(changes.withColumn(PART, part), "changes")
        keyed = replace(merge, keys=(PART, *merge.keys))

        version = self.current_version(name)
        here = None if version is None else self._folder(name, version)
        if not rows:
            # Without a part, a dealt table would have no file that tells its columns.
            if here is None:
                self.write(name, changes.drop(PART))
            return
        # As many values as buckets, or runs in the batch.
        touched = [r[PART] for r in changes.select(PART).distinct().collect()]
        if here is None:
            self._write_dealt(self._next(name), one_part(changes, touched))
            return
        if not self._is_dealt(here):
            old = self._scan(here).withColumn(PART, part)
            self._write_dealt(self._next(name), combine(old, changes, keyed, collapsed=True))
            return
        old = self.spark.read.parquet(here)
        if not set(changes.columns) <= set(old.columns):
            self._write_dealt(self._next(name), combine(old, changes, keyed, collapsed=True))
            return
        merged = combine(old.filter(F.col(PART).isin(touched)), changes, keyed, collapsed=True, small=small)
        merged, _ = folder.write(merged, "merged")
        self._replace_parts(here, one_part(merged, touched))
        folder.remove("merged")
        folder.remove("changes")

    def parts(self, name: str) -> set[str]:
        """The parts of the current version; none if the table is whole."""
        version = self.current_version(name)
        found = child_names(self.spark, self._folder(name, version)) if version else []
        return {c.split("=", 1)[1] for c in found if c.startswith(f"{PART}=")}

    def stored(self, name: str) -> DataFrame:
        """A dealt table's rows with their part, by which a filter prunes the files."""
        return self.spark.read.parquet(self._folder(name, self.current_version(name)))

    def write_parts(self, name: str, df: DataFrame) -> None:
        """A whole next version, dealt by the part column of its rows."""
        self._write_dealt(self._next(name), df)

    def replace_parts(self, name: str, df: DataFrame) -> None:
        """The rows' parts are these rows; the files of other parts stay. Rows are not read from here."""
        self._replace_parts(self._folder(name, self.current_version(name)), df)

    def add_to_run(self, name: str, df: DataFrame, run_id: str, keys: Sequence[str]) -> None:
        """Rows join those their run has, in place of rows with equal keys; other parts' files stay.

        A replay with the same keys changes nothing. Rows of a table that was
        whole are dealt into one part, once. Without rows nothing is written,
        but for the columns of a new table.
        """
        here = self.parts(name)
        new = df.withColumn(PART, run_part(F.lit(run_id)))
        if not self.exists(name):
            self.write(name, df) if df.isEmpty() else self.write_parts(name, new)
        elif run_name(run_id) in here:
            folder = StagedFolder(self.spark, f"run-{name}")
            new, _ = folder.write(new, "new")
            same = self.stored(name).filter(F.col(PART) == run_name(run_id))
            kept = same.join(new.select(*keys), list(keys), "left_anti").select(*new.columns)
            merged, _ = folder.write(kept.unionByName(new), "merged")
            self.replace_parts(name, merged)
        elif here:
            self.replace_parts(name, new)
        elif not df.isEmpty():
            whole = self.read(name).withColumn(PART, run_part(F.lit(None)))
            kept = whole.join(new.select(*keys), list(keys), "left_anti").select(*new.columns)
            self.write_parts(name, kept.unionByName(new))

    def _dealt_version(self, name: str, df: DataFrame, staged: bool = False) -> DataFrame:
        self._write_dealt(self._next(name), df, staged)
        return self.read(name)

    def _write_dealt(self, folder: str, df: DataFrame, staged: bool = False) -> None:
        df = df if staged else df.hint("rebalance", PART)
        df.write.partitionBy(PART).parquet(folder)

    def _replace_parts(self, folder: str, df: DataFrame, staged: bool = False) -> None:
        df = df if staged else df.hint("rebalance", PART)
        writer = df.write.mode("overwrite").partitionBy(PART)
        writer.option("partitionOverwriteMode", "dynamic").parquet(folder)

    def replace_run(
        self, name: str, df: DataFrame, run_id: str, loader: str = "", staged: bool = False
    ) -> DataFrame:
        """The rows of one run (and loader) are these; the files of other runs stay as they are.

        A replay replaces its own rows, so it adds nothing. Without rows the
        part that is there already stays. ``staged`` rows were read from files of
        a good size; they are one part, and are not moved to be dealt into it.
        """
        part = run_part(F.lit(f"{run_id}/{loader}" if loader else run_id))
        dealt = df.withColumn(PART, part)
        version = self.current_version(name)
        here = None if version is None else self._folder(name, version)
        if here is None:
            return self.write(name, df) if df.isEmpty() else self._dealt_version(name, dealt, staged)
        if self._is_dealt(here) and set(df.columns) <= set(self.read(name).columns):
            self._replace_parts(here, dealt, staged)
        else:
            stored = self.spark.read.parquet(here)
            if PART not in stored.columns:
                stored = stored.withColumn(PART, run_part(F.col(RUN))).filter(~F.col(RUN).eqNullSafe(F.lit(run_id)))
            others = stored.join(dealt.select(PART).distinct(), PART, "left_anti")
            rows = others.unionByName(dealt, allowMissingColumns=True)
            # Without a part, a dealt version would have no file that tells its columns.
            if not rows.isEmpty():
                self._write_dealt(self._next(name), rows)
        return self.read(name)
