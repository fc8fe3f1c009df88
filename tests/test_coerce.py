from datetime import date

import pytest

from jobweave.functions import coerce
from jobweave.functions.identifiers import split_identifiers
from jobweave.functions.names import with_folder_name
from jobweave.functions.roles import ROLE_BY_SPELLING, canonical_role


def values(spark, column, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r.v for r in frame.select("i", column("c").alias("v")).orderBy("i").collect()]


def test_blank_and_tokens(spark):
    texts = [None, "", "  ", "[Null]", "NULL", "none", "N/A", "na", " x \t", " y "]
    assert values(spark, coerce.blank_to_null, texts) == [
        None, None, None, "[Null]", "NULL", "none", "N/A", "na", "x", "y",
    ]
    assert values(spark, coerce.tokens_to_null, texts) == [None] * 8 + ["x", "y"]


def test_numbers(spark):
    texts = ["3", " +4 ", "-5", "1_0", "1.5", "x", "", None, "99999999999"]
    assert values(spark, coerce.to_integer, texts) == [
        3, 4, -5, None, None, None, None, None, 99999999999,
    ]
    assert values(spark, coerce.to_number, ["0.5", " 1 ", "1e-1", ".5", "1d", "nan", ""]) == [
        0.5, 1.0, 0.1, 0.5, None, None, None,
    ]


def test_flags(spark):
    texts = ["Yes", "y", "TRUE", "t", "1", "No", "n", "False", "f", "0", "maybe", "", "N/A", None]
    assert values(spark, coerce.to_flag, texts) == [True] * 5 + [False] * 5 + [None] * 4
    assert values(spark, coerce.to_strict_flag, ["on", "off", "maybe"]) == [True, False, None]


def test_days(spark):
    texts = ["2024-04-01", "2024-04-01T10:00:00", "20240401", "2024-4-1", "2024-13-01", "x", None]
    assert values(spark, coerce.to_day, texts) == [date(2024, 4, 1)] * 3 + [None] * 4
    assert values(spark, coerce.to_short_day, ["24-Aug-12", "9-Jan-26", "?"]) == [
        date(2012, 8, 24), date(2026, 1, 9), None,
    ]


def test_lists(spark):
    got = values(spark, lambda c: coerce.split_list(c, "|"), ["Java | SQL|| Python", ""])
    assert got == [["Java", "SQL", "Python"], []]


def test_roles(spark):
    assert len(ROLE_BY_SPELLING) == 27
    got = values(spark, canonical_role, [" Data Owner", "L2 manager", "BAO", "n/a", "chef", None])
    assert got == [
        "Primary Information Owner", "L2 Operate Manager", "Backup Application Owner", None, None, None,
    ]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("PRARAG-HLDM-111027-PEX", ("PRARAG", "P", "Production", "R", "Retail", "ARA", "G",
                                    "Group Table/Smart folder", ["HLDM", "111027", "PEX"], True)),
        ("drarag-x", ("drarag", "D", "Development", "R", "Retail", "ARA", "G",
                      "Group Table/Smart folder", ["x"], True)),
        ("PRARAG", ("PRARAG", "P", "Production", "R", "Retail", "ARA", "G",
                    "Group Table/Smart folder", [], True)),
        ("XX", ("XX", None, None, None, None, None, None, None, [], False)),
        ("", ("", None, None, None, None, None, None, None, [], False)),
        (None, ("", None, None, None, None, None, None, None, [], False)),
        ("PRARAX-HLDM-DLY", ("PRARAX", "P", "Production", "R", "Retail", "ARA", "X", None,
                             ["HLDM", "DLY"], True)),
        ("ZZA1CQ-a--b", ("ZZA1CQ", None, None, None, None, None, "Q", "Quarterly",
                         ["a", "", "b"], False)),
    ],
)
def test_folder_names(spark, name, expected):
    frame = spark.createDataFrame([(name,)], "n string")
    row = with_folder_name(frame, "n").drop("n").first()
    assert tuple(row) == expected


def test_identifiers(spark):
    frame = spark.createDataFrame(
        [("dcat:Dataset",), ("prov:Activity",), ("nope:foo",), ("Dataset",), ("swo:a:b",)], "c string"
    )
    good, bad = split_identifiers(frame, "c")
    assert {r.iri for r in good.collect()} == {
        "http://www.w3.org/ns/dcat#Dataset", "http://www.w3.org/ns/prov#Activity",
        "http://www.ebi.ac.uk/swo/a:b",
    }
    assert {(r.c, r.error) for r in bad.collect()} == {
        ("nope:foo", "unknown prefix"), ("Dataset", "not a compact identifier"),
    }
