"""Row specs: coercion, rules, and the split into accepted and rejected rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions import coerce
from jobweave.functions.roles import canonical_role
from jobweave.sources.files import StagedFolder
from jobweave.sources.readers import SEQ


@dataclass(frozen=True)
class Field:
    """One column of a row spec.

    ``nulls`` names what an optional text reads as NULL: ``blank``, ``tokens``
    or ``keep`` (nothing). ``nonempty`` is False for text that must be present
    but may be empty. Bounds apply to integers and numbers.
    """

    name: str
    kind: str = "text"  # text | integer | number | flag | strict_flag | day | role
    required: bool = False
    nonempty: bool = True
    nulls: str = "blank"
    low: float | None = None
    high: float | None = None
    default: object = None
    domain: tuple[str, ...] | None = None


@dataclass(frozen=True)
class RowSpec:
    """A source's columns and an optional enrichment of its accepted rows."""

    name: str
    fields: tuple[Field, ...]
    enrich: Callable[[DataFrame], DataFrame] | None = None

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


_PARSERS = {
    "integer": (coerce.to_integer, "integer", "bigint"),
    "number": (coerce.to_number, "number", "double"),
    "day": (coerce.to_day, "date", "date"),
    "strict_flag": (coerce.to_strict_flag, "boolean", "boolean"),
}


def _text(field: Field, raw: SparkColumn) -> SparkColumn:
    if field.nulls == "tokens":
        return coerce.tokens_to_null(raw)
    if field.nulls == "keep" or field.required:
        return coerce.strip(raw)
    return coerce.blank_to_null(raw)


def field_value(field: Field, raw: SparkColumn) -> SparkColumn:
    """The typed value of a field; NULL where the text cannot be read."""
    if field.kind == "text":
        return _text(field, raw)
    if field.kind == "flag":
        return coerce.to_flag(raw)
    if field.kind == "role":
        return canonical_role(raw)
    return _PARSERS[field.kind][0](raw)


def _given(field: Field, raw: SparkColumn) -> SparkColumn:
    """Whether a typed cell counts as present.

    Integers and dates read an empty cell as absent; other kinds reject it.
    """
    if field.kind in ("integer", "day"):
        return F.coalesce(raw.cast("string") != "", F.lit(False))
    return raw.isNotNull()


def field_errors(field: Field, value: SparkColumn, raw: SparkColumn) -> list[SparkColumn]:
    """The rules of a field over its computed value; a rule is NULL when it holds."""

    def rule(broken: SparkColumn, name: str) -> SparkColumn:
        return F.when(broken, F.lit(f"{field.name}:{name}"))

    errors = []
    if field.kind == "text":
        if field.required:
            missing = F.coalesce(value, F.lit("")) == "" if field.nonempty else value.isNull()
            errors.append(rule(missing, "required"))
        if field.domain:
            errors.append(rule(value.isNotNull() & ~value.isin(*field.domain), "domain"))
        return errors
    if field.kind == "flag":
        return errors
    if field.kind == "role":
        return [rule(value.isNull(), "domain")]
    given = _given(field, raw)
    if field.required:
        errors.append(rule(~given, "required"))
    errors.append(rule(given & value.isNull(), _PARSERS[field.kind][1]))
    if field.low is not None:
        errors.append(rule(value < F.lit(field.low), "range"))
    if field.high is not None:
        errors.append(rule(value > F.lit(field.high), "range"))
    return errors


def check_rows(df: DataFrame, spec: RowSpec, seq: str = SEQ) -> DataFrame:
    """Typed columns plus ``_errors`` (empty when accepted) and the raw row.

    Columns the spec does not know are dropped from the typed row; columns the
    source lacks are NULL. Values are one projection and rules the next, so a
    cell is parsed once however many rules look at it.
    """
    raw_names = [c for c in df.columns if c != seq]

    def cell(field: Field) -> SparkColumn:
        known = field.name in df.columns
        return F.col(f"_raw.{field.name}") if known else F.lit(None).cast("string")

    packed = df.select(F.col(seq), F.struct(*raw_names).alias("_raw"))
    typed = packed.select(
        seq, "_raw", *[field_value(f, cell(f)).alias(f.name) for f in spec.fields]
    )
    rules = [r for f in spec.fields for r in field_errors(f, F.col(f.name), cell(f))]
    errors = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")

    def final(field: Field) -> SparkColumn:
        value = F.col(field.name)
        if field.default is None:
            return value
        default = F.lit(field.default).cast(_PARSERS[field.kind][2])
        return F.when(_given(field, cell(field)), value).otherwise(default).alias(field.name)

    return typed.select(
        F.col(seq), *[final(f) for f in spec.fields], errors.alias("_errors"), "_raw"
    )


@dataclass(frozen=True)
class Checked:
    """Both halves of a checked source, with their counts when staged."""

    accepted: DataFrame
    rejected: DataFrame
    accepted_count: int | None = None
    rejected_count: int | None = None

    def reject_report(self, rows: int = 100) -> DataFrame:
        """The first rejects in input order; the full set is ``rejected``."""
        return self.rejected.orderBy(SEQ).limit(rows)


def split_rows(df: DataFrame, spec: RowSpec, seq: str = SEQ) -> Checked:
    """Accepted and rejected rows as two filters over one lazy plan.

    The task number keeps the optimizer from moving the filter below the
    parsing, where every cell would be parsed a second time.
    """
    checked = check_rows(df, spec, seq).withColumn("_task", F.spark_partition_id())
    passed = (F.size("_errors") == 0) & (F.col("_task") >= 0)
    accepted = checked.filter(passed).select(seq, *spec.names)
    if spec.enrich:
        accepted = spec.enrich(accepted)
    return Checked(accepted, checked.filter(~passed).select(seq, "_errors", "_raw"))


def split_rows_once(df: DataFrame, spec: RowSpec, seq: str = SEQ) -> Checked:
    """As :func:`split_rows`, but the source is scanned a single time.

    The checked rows are written to the shared folder as they come, with a flag
    and the raw row of rejected ones, and both counts are observed during that
    write. Two partitions would have each task sort all its rows by the flag.
    """
    from pyspark.sql import Observation

    checked = check_rows(df, spec, seq).withColumn("_ok", F.size("_errors") == 0)
    checked = checked.withColumn("_raw", F.when(~F.col("_ok"), F.col("_raw")))
    seen = Observation()
    folder = StagedFolder(df.sparkSession, f"checked-{spec.name}")
    checked.observe(
        seen,
        F.count_if(F.col("_ok")).alias("accepted"),
        F.count_if(~F.col("_ok")).alias("rejected"),
    ).write.parquet(f"{folder.root}/rows")
    staged = folder.read(checked.schema, "rows")
    accepted = staged.filter(F.col("_ok")).select(seq, *spec.names)
    if spec.enrich:
        accepted = spec.enrich(accepted)
    rejected = staged.filter(~F.col("_ok")).select(seq, "_errors", "_raw")
    counts = seen.get
    return Checked(accepted, rejected, int(counts["accepted"]), int(counts["rejected"]))


def error_counts(rejected: DataFrame) -> DataFrame:
    """Rejects per broken rule."""
    return (
        rejected.select(F.explode("_errors").alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
