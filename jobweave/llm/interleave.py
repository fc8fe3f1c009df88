"""Proportional stratified interleaving: shards that all match the mixture of sources.

Rows are shuffled within their source by a seeded hash and ranked; the rank as
a fraction of the source's size spreads every source evenly over [0, 1).
Sorted by that fraction and cut into equal runs, each shard holds every source
in proportion, to within about one row.

Ranks come in two steps, so no source is ordered in one task: rows fall into
buckets of the sort key, rows are numbered within a bucket, and running sums of
the bucket counts give each bucket its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import fresh, without

#: Rows that one bucket should hold; the number of buckets follows the table's size.
BUCKET_ROWS = 4096


def _fraction(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a text's md5."""
    return _fraction(F.md5(text.cast("binary")))


def _numbered(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Position from 0 of each row in its group, ordered by ``bucket`` and then ``order``."""
    size, before = fresh(df, "size"), fresh(df, "before")
    keys = [*group, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    above = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum(size).over(above), F.lit(0)).alias(before))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn(out, within)
        .join(offsets, keys)
        .withColumn(out, F.col(out) + F.col(before) - 1)
        .drop(before)
    )


def interleave(
    rows: DataFrame,
    shards: int,
    stratum_col: str = "source",
    id_col: str = "doc_id",
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard).

    Shard sizes differ by at most one. Rows of one id are ordered by all their
    other orderable columns, so only rows alike in every column are
    interchangeable. A null stratum is a stratum of its own and null ids share
    one place in the shuffle. Columns named ``shard`` or ``slot`` are replaced,
    all others stay. An empty table gives an empty result. Pass only the
    columns the shards should hold: each row is moved three times.
    """
    rows = without(rows, "shard", "slot")
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    names = {n: fresh(rows, n) for n in ("mix", "bucket", "stratum", "rank", "share", "place")}
    mix, bucket, stratum, rank, share, place = names.values()
    every = [
        F.col(f"`{f.name}`")
        for f in rows.schema
        if f.dataType.typeName() in ("string", "long", "integer", "double", "binary", "boolean")
    ]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    marked = rows.withColumns({mix: key, stratum: F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0"))})
    marked = marked.withColumn(bucket, F.floor(_fraction(F.col(mix)) * buckets))
    ranked = _numbered(marked, [stratum], bucket, [F.col(mix), *every], rank)
    sizes = marked.groupBy(stratum).agg(F.count(F.lit(1)).alias(share))
    # Each source starts at its own place, so sources of one row do not meet in one bucket.
    begin = unit_hash(F.concat(F.lit(f"{seed}:"), F.col(stratum)))
    spread = ranked.join(sizes, stratum).withColumn(share, (F.col(rank) + begin) / F.col(share))
    spread = spread.withColumns({bucket: F.floor(F.col(share) * buckets), place: F.lit(0)})
    # One group: the running sum goes over the bucket counts alone.
    placed = _numbered(spread, [place], bucket, [F.col(share), F.col(stratum)], rank)
    return (
        placed.withColumn("shard", F.expr(f"CAST({rank} * {shards} DIV {max(total, 1)} AS INT)"))
        .withColumn("slot", F.expr(f"{rank} - (shard * {total}L + {shards - 1}) DIV {shards}"))
        .drop(*names.values())
    )
