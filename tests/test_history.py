import hashlib
import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from jobweave.operators import history
from jobweave.operators.extras import version_changes
from jobweave.session import RunClock

STATE = "k string, name string, ids array<string>, flag boolean, n int"


def canonical(values):
    """The same text, made by the standard library."""
    def plain(v):
        return sorted((x for x in v if x is not None), key=str) if isinstance(v, list) else v

    return json.dumps({k: plain(v) for k, v in values.items()}, sort_keys=True)


def test_state_text_is_canonical(spark):
    rows = [
        ("a", 'quote " slash \\ tab \t', ["z", None, "b"], True, 3),
        ("b", None, [], None, None),
        ("c", "x", None, False, 0),
    ]
    hashed = history.hashed_state(spark.createDataFrame(rows, STATE), "k")
    for row in hashed.collect():
        k, name, ids, flag, n = next(r for r in rows if r[0] == row.entity_key)
        text = canonical({"name": name, "ids": ids or [], "flag": flag, "n": n})
        assert row.state_json == text
        assert row.hash == hashlib.sha256(text.encode()).hexdigest()


def run(spark, versions, states, day):
    clock = RunClock("r", f"{day} 00:00:00")
    state = history.hashed_state(spark.createDataFrame(states, "k string, v string"), "k")
    compared = history.compare_states(state, versions)
    counts = history.snapshot_counts(compared).first().asDict()
    after = history.advance_versions(compared, versions, clock)
    kept = spark.createDataFrame(after.collect(), after.schema)
    return kept, counts


def intervals(versions, key):
    rows = versions.filter(F.col("entity_key") == key).orderBy("valid_from", "created_at").collect()
    return [(str(r.valid_from), str(r.valid_to) if r.valid_to else None) for r in rows]


def test_back_and_forth_gives_three_versions(spark):
    versions, counts = run(spark, None, [("a", "A"), ("b", "B")], "2024-01-01")
    assert counts == {"new": 2, "unchanged": 0}
    versions, counts = run(spark, versions, [("a", "X"), ("b", "B")], "2024-01-05")
    assert counts == {"new": 1, "unchanged": 1}
    versions, counts = run(spark, versions, [("a", "A")], "2024-01-09")
    assert counts == {"new": 1, "unchanged": 0}
    assert intervals(versions, "a") == [
        ("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-09"), ("2024-01-09", None),
    ]
    assert intervals(versions, "b") == [("2024-01-01", None)]  # gone, still open


def test_two_versions_on_one_day(spark):
    versions, _ = run(spark, None, [("a", "A")], "2024-01-01")
    clock = RunClock("r", "2024-01-01 10:00:00")
    state = history.hashed_state(spark.createDataFrame([("a", "B")], "k string, v string"), "k")
    versions = history.advance_versions(history.compare_states(state, versions), versions, clock)
    assert intervals(versions, "a") == [("2024-01-01", "2024-01-01"), ("2024-01-01", None)]
    again = history.compare_states(state, versions)
    assert history.snapshot_counts(again).first().asDict() == {"new": 0, "unchanged": 1}


@pytest.mark.parametrize("seed", range(2))
def test_invariants(spark, seed):
    rng = random.Random(seed)
    versions = None
    for step in range(4):
        keys = rng.sample("abcdef", 4)
        states = [(k, rng.choice("xy")) for k in keys]
        versions, _ = run(spark, versions, states, f"2024-0{step + 1}-01")
    for key in "abcdef":
        spans = intervals(versions, key)
        assert sum(end is None for _, end in spans) == (1 if spans else 0)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def history_rows(spark, rows):
    full = [
        (f"{k}{start}", k, "h", "{}", date.fromisoformat(start), None, None) for k, start in rows
    ]
    return spark.createDataFrame(
        full,
        "snapshot_id string, entity_key string, hash string, state_json string, valid_from date, "
        "valid_to date, created_at timestamp",
    )


def test_prune(spark):
    rows = history_rows(
        spark,
        [
            ("only-old", "2001-01-01"), ("a", "2001-01-01"), ("a", "2002-01-01"),
            ("b", "2001-01-01"), ("b", "2023-01-01"), ("c", "2020-01-03"), ("c", "2019-01-01"),
        ],
    )
    today = date(2025, 1, 1)
    assert str(history.retention_cutoff(today)) == "2020-01-03"
    kept = {(r.entity_key, str(r.valid_from)) for r in history.prune_versions(rows, today).collect()}
    assert kept == {
        ("only-old", "2001-01-01"), ("a", "2002-01-01"), ("b", "2023-01-01"), ("c", "2020-01-03"),
    }
    assert history.pruned_count(rows, today).first().deleted == 3
    assert history.prune_versions(rows, today, years=30).count() == 7


def test_effective_dates_include_both_ends(spark):
    ranges = spark.createDataFrame(
        [("s", date(2010, 1, 1), date(2024, 3, 31), "old"), ("s", date(2024, 4, 1), None, "new")],
        "code string, effective_from date, effective_to date, era string",
    )
    days = [date(2009, 12, 31), date(2010, 1, 1), date(2024, 3, 31), date(2024, 4, 1), date(2050, 1, 1)]
    facts = spark.createDataFrame([("s", d) for d in days], "code string, day date")
    expected = {(days[1], "old"), (days[2], "old"), (days[3], "new"), (days[4], "new")}
    keyed = history.effective_join(facts, ranges, "day", ["code"])
    assert {(r.day, r.era) for r in keyed.collect()} == expected
    bucketed = history.effective_join(
        facts.select("day"), ranges, "day"
    )
    assert {(r.day, r.era) for r in bucketed.collect()} == expected
    plan = bucketed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_latest_and_members(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, n int, v string")
    latest = {tuple(r) for r in history.latest_per_key(rows, ["k"], F.col("n")).collect()}
    assert latest == {("a", 2, None), ("b", 1, "z")}
    pairs = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", "z"), ("b", None)], "k string, m string")
    assert [tuple(r) for r in history.sorted_members(pairs, "k", "m", "ms").collect()] == [("a", ["b", "z"])]


def test_changes_between_versions(spark):
    rows = spark.createDataFrame(
        [("a", 1, 1, "1", "x", "p"), ("a", 2, 1, "2", "x", None), ("a", 3, 1, "3", "y", None)],
        "entity_key string, valid_from int, created_at int, snapshot_id string, f string, g string",
    )
    changes = version_changes(rows, ["f", "g"]).orderBy("valid_from").collect()
    assert [r.changed_fields for r in changes] == [["g"], ["f"]]


def test_days_meet_ranges_by_their_intervals(spark):
    rng = random.Random(7)
    day = lambda n: date(1969, 12, 1) + timedelta(days=n)
    ranges = []
    for i in range(120):
        start = rng.randrange(0, 4000)
        length = rng.choice([0, 1, 2, 30, 365, 3000, -1])
        ranges.append((i, day(start), None if i % 7 == 0 else day(start + length)))
    ranges += [(900, None, day(5)), (901, date(1, 1, 1), date(9999, 12, 31)), (902, date(1, 1, 1), None)]
    facts = [(n, day(rng.randrange(-50, 4200))) for n in range(200)] + [(500, None), (501, date(9999, 12, 31)), (502, date(1, 1, 1))]
    left = spark.createDataFrame(facts, "n int, day date")
    right = spark.createDataFrame(ranges, "i int, effective_from date, effective_to date")
    got = sorted((r.n, r.i) for r in history.effective_join(left, right, "day").collect())
    expected = sorted(
        (n, i) for n, d in facts for i, a, b in ranges if d and a and a <= d and (b is None or d <= b)
    )
    assert got == expected and len(got) > 1000
    nodes = history.dyadic_nodes(right, "effective_from", "effective_to")
    assert nodes.groupBy("i", "_level").count().filter("count > 2").isEmpty()
    # A long range does not stand in as many places as it has days or years.
    assert nodes.filter("i = 902").count() <= 2 * 22
