"""Versions in parts: what a run reads and replaces, and what it leaves alone."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobweave.operators import history
from jobweave.session import RunClock
from jobweave.sinks.tables import PART, TableSet, run_name
from jobweave.sinks.versions import VersionTable
from jobweave.sources.files import stage


def clock(day):
    return RunClock(f"run {day}", f"{day} 00:00:00")


def states(spark, low, high, tag):
    rows = spark.range(low, high).select(F.col("id").cast("string").alias("id"), F.lit(tag).alias("state"))
    return history.hashed_state(rows, "id")


def files(root):
    found = {}
    for path in Path(root).rglob("*.parquet"):
        found.setdefault(path.parent.name.replace(f"{PART}=", ""), {})[path.name] = os.stat(path).st_mtime_ns
    return found


def rows(frame):
    return sorted(map(str, (tuple(r[c] for c in history.VERSION_COLUMNS) for r in frame.collect())))


def step(versions, plain, state, at):
    """One run on the parts and, beside it, on a whole frame."""
    compared = stage(history.compare_states(state, versions.open_versions()), "compared")
    versions.advance(compared, at)
    whole = stage(history.compare_states(state, plain), "whole")
    return stage(history.advance_versions(whole, plain, at), "plain")


def test_a_run_leaves_closed_versions_and_other_buckets_alone(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    versions = VersionTable(tables, "v", buckets=8)
    days = [clock(f"2026-01-0{d}") for d in range(1, 5)]
    plain = step(versions, None, states(spark, 0, 200, "a"), days[0])
    plain = step(versions, plain, states(spark, 0, 200, "b"), days[1])
    before = files(tmp_path / "v")
    assert run_name(days[1].run_id) in before and len(before) == 9
    plain = step(versions, plain, states(spark, 5, 7, "c"), days[2])
    after = files(tmp_path / "v")
    assert after[run_name(days[1].run_id)] == before[run_name(days[1].run_id)]
    assert sum(after[p] == before[p] for p in before) >= 7 and tables.current_version("v") == 1
    assert rows(tables.read("v")) == rows(plain)
    # A replay changes nothing; other states of the same run add to its part.
    replayed = files(tmp_path / "v")
    plain = step(versions, plain, states(spark, 5, 7, "c"), days[2])
    assert files(tmp_path / "v") == replayed
    plain = step(versions, plain, states(spark, 6, 9, "d"), days[2])
    assert rows(tables.read("v")) == rows(plain)
    opened = versions.open_versions()
    assert opened.count() == 200 and opened.filter("valid_to IS NOT NULL").isEmpty()
    assert versions.prune(clock("2036-01-01").run_date) == 200 + 2 + 3
    assert versions.open_versions().count() == tables.read("v").count() == 200


def test_a_run_cut_short_is_mended_by_itself(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    versions = VersionTable(tables, "v", buckets=4)
    plain = step(versions, None, states(spark, 0, 20, "a"), clock("2026-01-01"))
    real, tables.replace_parts = tables.replace_parts, None
    written = []

    def stops(name, df):
        if written:
            raise OSError("lost")
        written.append(name)
        real(name, df)

    tables.replace_parts = stops
    state, at = states(spark, 0, 5, "b"), clock("2026-01-02")
    compared = stage(history.compare_states(state, versions.open_versions()), "compared")
    with pytest.raises(OSError):
        versions.advance(compared, at)
    tables.replace_parts = real
    plain = step(versions, plain, state, at)
    assert rows(tables.read("v")) == rows(plain)


def test_empty_states_whole_tables_and_other_bucket_counts(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    empty = VersionTable(tables, "e")
    assert empty.open_versions() is None
    plain = step(empty, None, states(spark, 0, 0, "a"), clock("2026-01-01"))
    assert tables.read("e").isEmpty()
    plain = step(empty, plain, states(spark, 0, 3, "a"), clock("2026-01-02"))
    assert rows(tables.read("e")) == rows(plain)

    tables.write("v", plain)
    for buckets, tag in ((2, "b"), (4, "c")):
        plain = step(VersionTable(tables, "v", buckets), plain, states(spark, 0, 2, tag), clock("2026-01-03"))
        assert rows(tables.read("v")) == rows(plain)
    assert {p[:6] for p in tables.parts("v") if p.startswith("open")} == {"open4-"}
