"""Sources: delimited files, parquet, tables and JDBC queries, all as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.sources.files import path_exists

SEQ = "_seq"


def with_sequence(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Input order for first-wins / last-wins merges.

    A file scan numbers rows in file order; a source without an order names a
    column that has one. Rows that tie in it are ordered by a hash of the whole
    row, so first-wins and last-wins pick the same row on every run.
    """
    if not order_by:
        return df.withColumn(SEQ, F.monotonically_increasing_id())
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn(SEQ, F.struct(F.col(order_by).alias("by"), tie.alias("tie")))


def scan_delimited(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ",",
    encoding: str = "UTF-8",
    multi_line: bool = True,
) -> DataFrame:
    """Delimited text with a header; every value stays text.

    Header names are stripped and lower-cased, a leading byte-order mark is
    dropped, short rows are padded with ``''`` and surplus cells are ignored.
    ``multi_line`` allows line breaks inside quotes but makes one file one
    task: pass False for large extracts without such cells, so they split.
    """
    raw = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .csv(path)
    )
    names = [name.lstrip("﻿").strip().lower() for name in raw.columns]
    return raw.toDF(*names).na.fill("")


def read_delimited(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """:func:`scan_delimited` with its input order."""
    return with_sequence(scan_delimited(spark, path, **options))


@dataclass(frozen=True)
class JdbcQuery:
    """A database query read through Spark's JDBC source.

    Values are bound by filtering the frame: Spark pushes such filters into
    the query, so no text is pasted into it. Give a numeric
    ``partition_column`` with bounds to read in parallel.
    """

    url: str
    query: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None
    fetch_size: int = 1000
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None

    def options(self) -> dict[str, str]:
        text = self.query.strip().rstrip(";").rstrip()
        chosen = {
            "url": self.url,
            "fetchsize": str(self.fetch_size),
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
        }
        if self.partition_column:
            # A partitioned read takes a table expression instead of a query.
            chosen |= {
                "dbtable": f"({text}) source",
                "partitionColumn": self.partition_column,
                "lowerBound": str(self.lower_bound),
                "upperBound": str(self.upper_bound),
                "numPartitions": str(self.num_partitions),
            }
        else:
            chosen["query"] = text
        return {k: v for k, v in chosen.items() if v is not None}


def read_jdbc(
    spark: SparkSession, source: JdbcQuery, where: Mapping[str, Sequence] | None = None
) -> DataFrame:
    raw = spark.read.format("jdbc").options(**source.options()).load()
    frame = raw.toDF(*[name.lower() for name in raw.columns])
    for name, values in (where or {}).items():
        frame = frame.filter(F.col(name).isin(list(values)))
    return frame


@dataclass(frozen=True)
class Source:
    """Where one stage's rows come from; kinds are interchangeable.

    ``location`` is a path, a table name, a :class:`JdbcQuery` or a DataFrame.
    """

    kind: str  # delimited | parquet | table | jdbc | frame
    location: object
    options: Mapping = field(default_factory=dict)
    order_by: str | None = None

    def exists(self, spark: SparkSession) -> bool:
        if self.kind in ("delimited", "parquet"):
            return path_exists(spark, str(self.location))
        if self.kind == "table":
            return spark.catalog.tableExists(str(self.location))
        return True

    def read(
        self, spark: SparkSession, prepare: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """The rows in input order.

        ``prepare`` filters and projects before rows are numbered: a filter
        after the numbering would not be pushed into the source.
        """
        frame = self._scan(spark)
        if prepare is not None:
            frame = prepare(frame)
        return frame if SEQ in frame.columns else with_sequence(frame, self.order_by)

    def _scan(self, spark: SparkSession) -> DataFrame:
        if self.kind == "delimited":
            return scan_delimited(spark, str(self.location), **self.options)
        if self.kind == "jdbc":
            return read_jdbc(spark, self.location, **self.options)
        if self.kind == "parquet":
            frame = spark.read.parquet(str(self.location))
        elif self.kind == "table":
            frame = spark.table(str(self.location))
        elif self.kind == "frame":
            frame = self.location
        else:
            raise ValueError(f"unknown source kind {self.kind!r}")
        return frame.toDF(*[name.strip().lower() for name in frame.columns])


def stage_sources(
    stages: Sequence[str],
    folder: str | None = None,
    suffix: str = ".csv",
    queries: Mapping[str, JdbcQuery] | None = None,
    options: Mapping[str, Mapping] | None = None,
    order_by: Mapping[str, str] | None = None,
) -> dict[str, Source]:
    """One source per stage: files of a folder, or database queries.

    With both, a stage that has a query is read from the database and the others
    from files. ``options`` and ``order_by`` give a stage its own reader options
    (a separator, ``multi_line``) and the column that orders its rows. A stage
    that is not among ``stages`` is refused.
    """
    options, order_by = options or {}, order_by or {}
    unknown = sorted({*(queries or {}), *options, *order_by} - set(stages))
    if unknown:
        raise ValueError(f"no such stage: {', '.join(unknown)}")
    kind = "parquet" if suffix.startswith(".parquet") else "delimited"
    sources = {}
    for name in stages:
        extra = {"options": options.get(name, {}), "order_by": order_by.get(name)}
        if name in (queries or {}):
            sources[name] = Source("jdbc", queries[name], **extra)
        elif folder is not None:
            sources[name] = Source(kind, f"{folder}/{name}{suffix}", **extra)
    return sources


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small fixed table as a local relation, so Spark knows its true size."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    columns = [pa.array([row[i] for row in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=struct)
