"""Reconciliation compares two sources by aggregation: no sort of whole sources, missing values match nothing."""

from __future__ import annotations

from jobweave.operators import extras


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_holders_are_compared_in_one_aggregation(spark):
    schema = "k string, who string"
    left = spark.createDataFrame(
        [("p", "x"), ("p", "x"), ("p", "y"), ("q", "x"), (None, "x"), ("q", None), (None, "x")], schema
    )
    right = spark.createDataFrame([("p", "x"), ("q", "y"), (None, "x"), ("q", None), ("r", "z")], schema)
    found = extras.holder_not_among(left, right, "k", "who")
    want = [(None, "x"), ("p", "y"), ("q", None), ("q", "x")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in plan(found) and found.columns == ["k", "who"]


def test_children_of_one_person_meet_the_contact_once(spark):
    contact = spark.createDataFrame([("p", "x"), ("q", "x"), ("r", None), ("s", "x")], "k string, who string")
    children = [("p", "y")] * 4 + [("p", None), ("q", "y"), ("q", "x"), ("q", "x"), ("r", "y"), ("s", None)]
    child = spark.createDataFrame(children, "k string, cto string")
    found = extras.differs_from_all(contact, child, "k", "who", "cto")
    assert list(map(tuple, found.collect())) == [("p", "x")]
    # The children are reduced below the join.
    below = plan(found).split("Join", 1)[1]
    assert "HashAggregate(keys=[k" in below or "SortAggregate(key=[k" in below
