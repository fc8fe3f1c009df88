from pathlib import Path
from datetime import datetime, timedelta

import pytest
from estate import write_scheduler
from pyspark.sql import functions as F

from jobweave.operators.extras import pair_checks
from jobweave.operators.upsert import Merge, collapse_ordered, upsert, upsert_ordered, without_order
from jobweave.plans.loads import FOLDERS
from jobweave.sinks.runs import RunLog
from jobweave.sinks.tables import TableSet
from jobweave.sources.readers import read_delimited
from jobweave.streaming.micro_batch import file_stream, in_time, load_stream, merge_stream
from jobweave.streaming.pairs import append_pairs, pair_stream

MERGE = Merge(("k",), ("first",), ("last",))


def test_many_batches_equal_one(spark, tmp_path):
    rows = spark.range(60).select(
        (F.col("id") % 7).alias("k"), F.col("id").alias("first"), F.col("id").alias("last"),
        F.col("id").alias("_seq"),
    )
    for part in range(3):
        rows.filter((F.col("id") >= part * 20) & (F.col("id") < part * 20 + 20)).coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
    tables = TableSet(spark, str(tmp_path / "t"))
    stream = file_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)
    query = merge_stream(stream, tables, "n", MERGE, str(tmp_path / "c"))
    query.awaitTermination()
    assert tables.current_version("n") == 3
    expected = upsert(None, rows, MERGE)
    assert sorted(map(tuple, without_order(tables.read("n"), MERGE).collect())) == sorted(map(tuple, expected.collect()))
    again = merge_stream(stream, tables, "n", MERGE, str(tmp_path / "c"))
    again.awaitTermination()
    assert tables.current_version("n") == 3  # nothing new, nothing written


def test_a_load_fed_by_a_stream(spark, tmp_path):
    folder = write_scheduler(tmp_path)
    rows = read_delimited(spark, str(folder / "controlm_folders.csv"))
    rows.write.parquet(str(tmp_path / "in"))
    tables = TableSet(spark, str(tmp_path / "t"))
    stream = file_stream(spark, str(tmp_path / "in"), rows.schema)
    load_stream(stream, tables, FOLDERS, str(tmp_path / "c")).awaitTermination()
    assert tables.read("job_folder").count() == 6
    assert RunLog(tables).runs().first().source == "stream"


def ordered_rows(spark):
    rows = [(i % 5, i, i if i % 3 else None, i if i % 4 == 0 else None, (i * 7) % 60) for i in range(60)]
    return spark.createDataFrame(rows, "k int, first int, last int, kept int, _seq int")


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("buckets", [None, {"n": 3}])
def test_batches_in_any_order_equal_one(spark, tmp_path, small, buckets):
    rows, merge = ordered_rows(spark), Merge(("k",), ("first",), ("last",), ("kept",))
    tables = TableSet(spark, str(tmp_path), buckets)
    for part in (2, 0, 1, 2, 0):
        tables.merge("n", rows.filter(F.col("first") % 3 == part), merge, small=small, ordered=True)
    expected = upsert(None, rows, merge)
    got = without_order(tables.read("n"), merge)
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_rows_without_a_place_never_win(spark):
    merge = Merge(("k",), ("first",), ("last",))
    rows = spark.createDataFrame([(1, "a", "a", 5), (2, "b", "b", None)], "k int, first string, last string, _seq int")
    late = spark.createDataFrame([(1, "z", "z", None), (2, "c", "c", 1)], rows.schema)
    state = upsert_ordered(collapse_ordered(rows, merge), late, merge)
    got = {r.k: (r.first, r["last"]) for r in state.collect()}
    assert got == {1: ("a", "a"), 2: ("c", "c")}


def test_watermark_bounds_how_late_a_row_may_be(spark, tmp_path):
    schema = "k int, first int, last int, ts timestamp, _seq int"
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    files = [
        [(1, 1, 1, day(10), 10)],
        [(1, 2, 2, day(30), 30), (1, 1, 1, day(10), 10)],
        [(1, 3, 3, day(25), 25)],  # late, within the delay
        [(1, 4, 4, day(1), 1)],  # too late: it would be the first
        [(2, 5, 5, day(31), 31)],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tables = TableSet(spark, str(tmp_path / "t"))
    stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, max_files=1)
    merge_stream(in_time(stream, "ts", "7 days", ["k", "_seq"]), tables, "n", MERGE, str(tmp_path / "c")).awaitTermination()
    assert {r.k: (r.first, r["last"]) for r in tables.read("n").collect()} == {1: (1, 2), 2: (5, 5)}


def test_pairs_of_two_streams_equal_pairs_of_two_tables(spark, tmp_path):
    """Halves that come early, late or never; those that never come are released when time has passed."""
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    schema = "dataset int, day timestamp, n int"
    data = [(d, day(t), d + t) for t in range(12) for d in range(4) if (d + t) % 5]
    control = [(d, day(t), d + t + (d == 2)) for t in range(12) for d in range(4) if (d + t) % 3]
    far = [(None, day(400), None)]
    for name, rows, cuts in (("data", data, (10, 25)), ("control", control, (4, 8))):
        for part in (rows[: cuts[0]], rows[cuts[1] :], rows[cuts[0] : cuts[1]], far):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    frames = [spark.createDataFrame(rows, schema) for rows in (data, control)]
    checks = {"same": F.col("data_n") == F.col("control_n")}
    expected = pair_checks(*frames, ["dataset", "day"], checks)
    streams = [file_stream(spark, str(tmp_path / n), frames[0].schema, max_files=1) for n in ("data", "control")]
    pairs = pair_stream(*streams, ["dataset", "day"], "day", "30 days", checks)
    append_pairs(pairs, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("dataset IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert {r.pair for r in got.collect()} == {"paired", "control missing", "data missing"}
    again = append_pairs(pairs, str(tmp_path / "out"), str(tmp_path / "c"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("dataset IS NOT NULL").count() == got.count()
    with pytest.raises(ValueError):
        pair_stream(*streams, ["dataset"], "day", "30 days", checks)


def test_more_files_do_not_make_more_batches(spark, tmp_path):
    """A batch of the pair query takes the files of a year at least, however many they are."""
    from jobweave.queries.views import pair_checks_stream

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    old = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # As if each staged file were large: none is read together with another.
        spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        pairs = pair_checks_stream(spark, str(tmp_path))
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    root = pairs.inputFiles()[0].rsplit("/pairs/", 1)[0].removeprefix("file://")
    years = lines.selectExpr("year(l_shipdate) AS y").distinct().count()
    batches = [p for p in Path(root, "checkpoint", "offsets").iterdir() if p.name.isdigit()]
    assert len(batches) <= years + 3
