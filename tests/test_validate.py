import pytest

from jobweave.operators.validate import Field, RowSpec, error_counts, split_rows, split_rows_once
from jobweave.sources import specs

SCHEDULER = {"folder_id": "1", "job_id": "2", "version_serial": "3"}


def check(spark, spec, row):
    schema = ", ".join(f"`{k}` string" for k in row) + ", _seq bigint"
    frame = spark.createDataFrame([(*row.values(), 0)], schema)
    checked = split_rows(frame, spec)
    good, bad = checked.accepted.collect(), checked.rejected.collect()
    assert len(good) + len(bad) == 1
    return good[0] if good else None, bad[0]._errors if bad else []


def test_folder(spark):
    row = {
        "folder_id": "100", "sched_table": " PRSHPG-A ", "data_center": "S1", "user_daily": "Y",
        "table_type": "2", "surplus": "dropped",
    }
    good, _ = check(spark, specs.FOLDERS, row)
    assert (good.sched_table, good.table_type, good.active, good.app_code) == ("PRSHPG-A", 2, True, "SHP")
    assert good.instance_name is None and "surplus" not in good.asDict()
    good, _ = check(spark, specs.FOLDERS, {**row, "user_daily": " "})
    assert good.active is False
    assert check(spark, specs.FOLDERS, {**row, "sched_table": " "})[1] == ["sched_table:required"]
    assert check(spark, specs.FOLDERS, {**row, "table_type": "two"})[1] == ["table_type:integer"]
    # a blank but not empty cell is not read as absent
    assert check(spark, specs.FOLDERS, {**row, "table_type": " "})[1] == ["table_type:integer"]
    assert check(spark, specs.FOLDERS, {**row, "table_type": ""})[1] == []


def test_job(spark):
    row = {**SCHEDULER, "job_name": "LOAD", "is_current_version": "1", "job_order": ""}
    good, _ = check(spark, specs.JOBS, row)
    assert (good.version_serial, good.active, good.job_order) == (3, True, None)
    assert check(spark, specs.JOBS, {**row, "is_current_version": "0"})[0].active is False
    assert check(spark, specs.JOBS, {**row, "is_current_version": ""})[0].active is None
    assert check(spark, specs.JOBS, {**row, "version_serial": "x"})[1] == ["version_serial:integer"]
    assert check(spark, specs.JOBS, {**row, "version_serial": "-1"})[1] == ["version_serial:range"]
    assert check(spark, specs.JOBS, {**row, "version_serial": ""})[1] == ["version_serial:required"]


def test_conditions(spark):
    row = {**SCHEDULER, "condition_name": "C", "order_": "1", "and_or": "AND", "sign": "+"}
    good, _ = check(spark, specs.CONDITIONS_IN, row)
    assert (good.order_, good.and_or) == (1, "AND") and "sign" not in good.asDict()
    good, _ = check(spark, specs.CONDITIONS_OUT, row)
    assert good.sign == "+" and "and_or" not in good.asDict()
    assert check(spark, specs.CONDITIONS_OUT, {**row, "condition_name": ""})[1] == [
        "condition_name:required"
    ]


def test_dependency(spark):
    row = {name: "x" for name in specs.DEPENDENCIES.names} | {"recursion_level": "1"}
    good, _ = check(spark, specs.DEPENDENCIES, row)
    assert good.recursion_level == 1
    assert check(spark, specs.DEPENDENCIES, {**row, "in_job_id": ""})[1] == []
    assert check(spark, specs.DEPENDENCIES, {**row, "in_job_id": None})[1] == ["in_job_id:required"]
    assert check(spark, specs.DEPENDENCIES, {**row, "recursion_level": "0"})[1] == [
        "recursion_level:range"
    ]
    assert check(spark, specs.DEPENDENCIES, {**row, "dependent_job": ""})[1] == [
        "dependent_job:required"
    ]


def test_application(spark):
    good, _ = check(
        spark,
        specs.APPLICATIONS,
        {"app_id": " 1 ", "name": "A", "sox_reportable": "maybe", "phi": "Yes", "kapp": "[Null]"},
    )
    assert (good.app_id, good.sox_reportable, good.phi, good.kapp) == ("1", None, True, None)
    assert len(specs.APPLICATIONS.fields) == 87
    assert check(spark, specs.APPLICATIONS, {"app_id": "[null]", "name": "n/a"})[1] == [
        "app_id:required", "name:required",
    ]


def test_contact(spark):
    row = {"app_id": "1", "role_name": "pio", "employee_sid": "E1", "employee_name": "none"}
    good, _ = check(spark, specs.CONTACTS, row)
    assert (good.role_name, good.employee_name) == ("Primary Information Owner", None)
    assert check(spark, specs.CONTACTS, {**row, "role_name": "chef"})[1] == ["role_name:domain"]
    assert check(spark, specs.CONTACTS, {**row, "employee_sid": "NA"})[1] == ["employee_sid:required"]


@pytest.mark.parametrize(
    "confidence, errors",
    [
        ("0.5", []), ("1", []), (None, []), ("", ["reconcile_confidence:number"]),
        ("1.5", ["reconcile_confidence:range"]), ("x", ["reconcile_confidence:number"]),
    ],
)
def test_lob_confidence(spark, confidence, errors):
    row = {"lob_id": "L", "code": " ", "reconcile_confidence": confidence}
    good, found = check(spark, specs.LOBS, row)
    assert found == errors
    if good:
        assert good.code == ""  # catalog text keeps an empty cell


def test_segment(spark):
    row = {"code": "X", "name": "N", "effective_from": "2024-04-01", "effective_to": ""}
    good, _ = check(spark, specs.SEGMENTS, row)
    assert str(good.effective_from) == "2024-04-01" and good.effective_to is None
    assert good.retired is False
    assert check(spark, specs.SEGMENTS, {**row, "retired": "true"})[0].retired is True
    assert check(spark, specs.SEGMENTS, {**row, "retired": ""})[1] == ["retired:boolean"]
    assert check(spark, specs.SEGMENTS, {**row, "effective_to": "soon"})[1] == ["effective_to:date"]


def test_catalog_children(spark):
    for spec in (specs.PRODUCT_LINES, specs.PRODUCTS, specs.DEV_TEAMS):
        key = spec.names[0]
        row = {name: "v" for name in spec.names}
        assert check(spark, spec, row)[1] == []
        assert check(spark, spec, {**row, key: ""})[1] == [f"{key}:required"]
    assert check(spark, specs.DEV_TEAMS, {"team_id": "T", "name": "N"})[1] == []


def test_split_counts_and_report(spark):
    spec = RowSpec("smoke", (Field("id", required=True), Field("value", "integer", required=True)))
    rows = [("good", "1", 0), ("bad", "not-an-int", 1), ("", "", 2)]
    frame = spark.createDataFrame(rows, "id string, value string, _seq bigint")
    checked = split_rows_once(frame, spec)
    assert (checked.accepted_count, checked.rejected_count) == (1, 2)
    report = checked.reject_report(1).collect()
    assert [r._seq for r in report] == [1] and report[0]._raw.value == "not-an-int"
    counts = {r.error: r.rows for r in error_counts(checked.rejected).collect()}
    assert counts == {"value:integer": 1, "value:required": 1, "id:required": 1}
    lazy = split_rows(frame, spec)
    assert lazy.accepted.collect() == checked.accepted.collect()
