from pyspark.sql import functions as F

from jobweave.operators import extras, quality
from jobweave.operators.reshape import flag_orphans, splay_list, wide_to_long


def rows(frame):
    return {tuple(r) for r in frame.collect()}


def test_reach_stops_at_the_hop_limit_and_in_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "m int, e int")
    reached = extras.bounded_reach(chain, "m", "e", 6)
    assert rows(reached.filter("m = 0").select("e", "hops")) == {(i, i) for i in range(1, 7)}
    loop = spark.createDataFrame([(1, 2), (2, 1)], "m int, e int")
    assert rows(extras.bounded_reach(loop, "m", "e", 6)) == {(1, 2, 1), (2, 1, 1), (1, 1, 2), (2, 2, 2)}


def test_support_team_counts_people_once(spark):
    managers = spark.createDataFrame([("app", "m")], "seal_id string, manager_id string")
    manages = spark.createDataFrame(
        [("m", "a"), ("m", "b"), ("a", "c"), ("b", "c")], "manager_id string, employee_id string"
    )
    groups = spark.createDataFrame(
        [("a", "g"), ("c", "g"), ("b", "h")], "employee_id string, group_name string"
    )
    teams = extras.support_teams(managers, manages, groups)
    assert rows(teams.select("seal_id", "group_name", "team_size")) == {("app", "g", 2), ("app", "h", 1)}


def test_channels(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job int")
    requires = spark.createDataFrame([(1, "c"), (2, "own"), (4, "none"), (4, "c")], "job int, condition string")
    emits = spark.createDataFrame([(3, "c"), (2, "own")], "job int, condition string")
    got = extras.attribute_channels(jobs, requires, emits, ["job"], F.lit("ApiChannel"))
    assert rows(got) == {
        (1, "UpstreamJobChannel"), (2, "ApiChannel"), (3, "TimeChannel"), (4, "UpstreamJobChannel"),
    }


def test_pairs_with_a_missing_half_are_never_certified(spark):
    data = spark.createDataFrame([("d", 1, 10), ("d", 2, 5)], "ds string, day int, n int")
    control = spark.createDataFrame([("d", 1, 10), ("d", 3, 5)], "ds string, day int, n int")
    checked = extras.pair_checks(
        data, control, ["ds", "day"], {"rowcount_match": F.col("data_n") == F.col("control_n")}
    )
    assert rows(checked.select("day", "pair", "certified")) == {
        (1, "paired", True), (2, "control missing", False), (3, "data missing", False),
    }


def test_disagreements(spark):
    contact = spark.createDataFrame([("p", "x"), ("q", "y")], "k string, who string")
    child = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "y"), ("q", "z")], "k string, cto string")
    assert rows(extras.differs_from_all(contact, child, "k", "who", "cto")) == {("p", "x")}
    held = spark.createDataFrame([("p", "L2")], "k string, role_name string")
    assert rows(extras.missing_role(contact, held, "k", "L2")) == {("q",)}


def test_lists_and_wide_rows(spark):
    frame = spark.createDataFrame([(1, "7, 8,,7"), (2, "")], "id int, ids string")
    split = splay_list(frame, "ids", "ref")
    assert rows(split) == {(1, "7"), (1, "8")}
    known = spark.createDataFrame([("7",), ("7",)], "ref string")
    assert rows(flag_orphans(split, known, "ref").select("ref", "orphan")) == {("7", False), ("8", True)}
    wide = spark.createDataFrame([(1, "a", None, "c")], "id int, x string, y string, z string")
    long = wide_to_long(wide, ["id"], {"X": ["x"], "Y": ["y"], "Z": ["z"]}, ["v"], "role")
    assert rows(long) == {(1, 0, "X", "a"), (1, 2, "Z", "c")}


def test_linked_rows_count_like_an_optional_match(spark):
    folders = spark.createDataFrame([(1,), (2,), (3,)], "f int")
    links = spark.createDataFrame([(1,), (1,), (2,)], "f int")
    row = quality.every_row_linked(folders, links, ["f"], "c", ("folders", "links")).first()
    assert (row.ok, row.detail) == (False, "folders=4 links=3")
    row = quality.every_row_linked(folders.filter("f < 3"), links, ["f"], "c").first()
    assert (row.ok, row.detail) == (True, "rows=3 linked=3")


def test_keys_registry_and_overall(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "k int, v string")
    assert tuple(quality.key_report(frame, ["k"], "t").first()) == ("t", 2, 1)
    checks = quality.report([quality.check_key(frame, ["k"], "bad"), quality.no_duplicates(frame.limit(1), ["v"], "ok")])
    assert tuple(quality.overall(checks).first()) == (False, 1)
    seen = spark.createDataFrame([("E", "A", "B"), ("E", "A", "C"), ("G", "Z", "R")],
                                 "edge_type string, from_node string, to_node string")
    registry = spark.createDataFrame([("E", "A", "B", "active"), ("G", "*", "R", "active")],
                                     "edge_type string, from_node string, to_node string, status string")
    assert rows(quality.edge_registry_gaps(seen, registry)) == {("E", "A", "C")}
