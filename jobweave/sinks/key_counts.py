"""Key checks that follow a table's loads, without grouping the whole table after each.

Every run leaves the rows it has per key hash. Hashes that a run holds twice, or
that other runs hold as well, are written down as doubtful when the run is
added; a report then reads only rows with a doubtful hash and compares their
keys exactly. So an added run moves its own hashes and scans the stored ones,
and a report without doubt reads no row of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.quality import has_null, key_verdict
from jobweave.sinks.tables import PART, RUN, TableSet, run_name
from jobweave.sources.files import StagedFolder

HASH = "key_hash"


class KeyCounts:
    """The stored counts of one key of one table: ``<name>_key_count`` and ``<name>_key_doubt``.

    A run that is added again replaces what it left, also with fewer rows or
    none. Doubtful hashes may outlive the doubt; a report decides by the rows.
    One writer at a time, as for any table of a :class:`TableSet`; a run cut
    short is mended by adding it again.
    """

    def __init__(self, tables: TableSet, name: str, keys: Sequence[str]) -> None:
        self.tables = tables
        self.keys = tuple(keys)
        self.counts = f"{name}_key_count"
        self.doubts = f"{name}_key_doubt"

    def key_hash(self) -> Column:
        """Equal keys have equal hashes, -0.0 and 0.0 included."""
        return F.xxhash64(*self.keys)

    def add(self, rows: DataFrame, run_id: str) -> None:
        """Count the rows of a run. Columns other than the key are not read."""
        spark = rows.sparkSession
        run = F.lit(run_id).alias(RUN)
        held = rows.groupBy(F.when(~has_null(self.keys), self.key_hash()).alias(HASH)).agg(F.count(F.lit(1)).alias("n"))
        # A run without rows or doubts leaves a row too, which replaces what it left before.
        none = spark.range(1).select(F.lit(None).cast("bigint").alias(HASH), F.lit(0).cast("bigint").alias("n"))
        folder = StagedFolder(spark, "key-counts")
        mine, _ = folder.write(held.unionByName(none).withColumn(RUN, run), "mine")

        doubtful = mine.filter(F.col(HASH).isNotNull() & (F.col("n") > 1)).select(HASH)
        if self.tables.exists(self.counts):
            others = self.tables.stored(self.counts).filter(F.col(PART) != run_name(run_id))
            # The stored side streams past the run's hashes, which Spark may broadcast if they are few.
            doubtful = doubtful.unionByName(others.join(mine, HASH, "left_semi").select(HASH))
        doubtful = doubtful.distinct().unionByName(none.select(HASH)).withColumn(RUN, run)
        doubtful, _ = folder.write(doubtful, "doubtful")
        # Doubts first: counts without their doubts would hide a duplicate.
        self.tables.replace_run(self.doubts, doubtful, run_id, staged=True)
        self.tables.replace_run(self.counts, mine, run_id, staged=True)
        folder.remove("mine")
        folder.remove("doubtful")

    def runs_in_doubt(self) -> list[str]:
        """The runs that hold a doubtful hash, in their order: all that a report has to read."""
        doubtful = self.tables.read(self.doubts).select(HASH)
        held = self.tables.read(self.counts).join(doubtful, HASH, "left_semi")
        return sorted(r[RUN] for r in held.select(RUN).distinct().collect())

    def duplicates(self, rows: DataFrame, run_col: str | None = None) -> DataFrame:
        """(keys, n) of each key without NULLs that several rows hold.

        ``rows`` are all rows of the added runs. With ``run_col`` only runs in
        doubt are read, which prunes a table that is dealt by it.
        """
        if run_col is not None:
            rows = rows.filter(F.col(run_col).isin(self.runs_in_doubt()))
        doubtful = self.tables.read(self.doubts).select(HASH)
        suspects = rows.filter(~has_null(self.keys)).select(*self.keys, self.key_hash().alias(HASH))
        # The hash is in the grouping, so rows the join has moved by it are not moved again.
        suspects = suspects.join(doubtful, HASH, "left_semi").groupBy(HASH, *self.keys)
        return suspects.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop(HASH)

    def report(self, rows: DataFrame, name: str, run_col: str | None = None) -> DataFrame:
        """What ``quality.key_report`` says of all rows."""
        zero = F.lit(0).cast("bigint")
        nulls = self.tables.read(self.counts).filter(F.col(HASH).isNull()).select(
            F.col("n").alias("null_keys"), zero.alias("duplicate_keys")
        )
        twice = self.duplicates(rows, run_col).agg(F.count(F.lit(1)).alias("duplicate_keys"))
        both = nulls.unionByName(twice.withColumn("null_keys", zero))
        return both.agg(
            F.coalesce(F.sum("null_keys"), zero).alias("null_keys"),
            F.coalesce(F.sum("duplicate_keys"), zero).alias("duplicate_keys"),
        ).select(F.lit(name).alias("check"), "null_keys", "duplicate_keys")

    def check(self, rows: DataFrame, name: str, run_col: str | None = None) -> DataFrame:
        """What ``quality.check_key`` says of all rows."""
        return key_verdict(self.report(rows, name, run_col), name)
