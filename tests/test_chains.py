import json
from collections import Counter

import pytest
from estate import HOPS, walked, write_csv, write_reference, write_scheduler
from pyspark.sql import functions as F

from jobweave.plans import chains
from jobweave.plans.loads import LOADS
from jobweave.session import RunClock
from jobweave.sinks.runs import RunLog
from jobweave.sinks.tables import TableSet
from jobweave.sources import vocabulary
from jobweave.sources.readers import Source, stage_sources

NEEDED = sum(map(len, HOPS.values()))
CLOCK = RunClock("chain", "2026-01-05 06:00:00")


@pytest.fixture(scope="module")
def scheduler(spark, tmp_path_factory):
    folder = write_scheduler(tmp_path_factory.mktemp("scheduler"))
    tables = TableSet(spark, str(folder / "tables"))
    chains.bootstrap(tables)
    sources = stage_sources(chains.SCHEDULER_STAGES, str(folder))
    results = chains.ingest_scheduler(tables, sources, CLOCK)
    return tables, sources, results


@pytest.fixture(scope="module")
def reference(spark, tmp_path_factory):
    folder = write_reference(tmp_path_factory.mktemp("reference"))
    tables = TableSet(spark, str(folder / "tables"))
    chains.bootstrap(tables)
    sources = stage_sources(chains.REFERENCE_STAGES, str(folder))
    results = chains.refresh_reference(tables, sources, CLOCK)
    return tables, sources, results, folder


def counts(results):
    return {
        name: (r["rows_processed"], r["rows_rejected"], r["rows_unmatched"])
        for name, r in results.items()
        if "rows_processed" in r
    }


def test_scheduler_counts(scheduler):
    tables, _, results = scheduler
    assert counts(results) == {
        "controlm_folders": (6, 0, 0),
        "controlm_jobs": (14, 0, 0),
        "controlm_conditions_in": (NEEDED, 0, 0),
        "controlm_conditions_out": (14, 0, 0),
        # One row per edge, however many paths lead along it.
        "controlm_dependencies_derived": (len({(p[0], p[-1]) for p in walked()}), 0, 0),
    }
    size = {n: tables.read(n).count() for n in tables.names()}
    assert (size["job_folder"], size["controlm_job"], size["condition"]) == (6, 14, 14 + 9)
    assert (size["controlm_server"], size["runs_on"], size["contains_job"]) == (3, 6, 14)
    assert (size["requires_in_condition"], size["emits_out_condition"]) == (NEEDED, 14)
    assert size["was_informed_by"] == len({(p[0], p[-1]) for p in walked()}) and RunLog(tables).runs().count() == 5
    assert "rejected_row" not in size and "unmatched_row" not in size
    runs = RunLog(tables).runs().collect()
    assert {r.status for r in runs} == {"OK"} and {r.source for r in runs} == {"csv"}


def test_scheduler_rows(scheduler):
    tables, _, _ = scheduler
    folder = tables.read("job_folder").filter("folder_id = '8005'").first()
    assert folder.active is False and folder.lob_code == "R" and folder.app_code == "ZQE"
    shared = tables.read("condition").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in shared} == {
        "scheduler.conditions_in": 9, "scheduler.conditions_out": 14,
    }
    levels = tables.read("was_informed_by").groupBy("recursion_level").count().collect()
    edges = Counter(n - 1 for n in {(p[0], p[-1]): len(p) for p in walked()}.values())
    assert {r.recursion_level: r["count"] for r in levels} == edges  # all ways between two jobs are as long


def test_scheduler_checks(scheduler):
    tables, _, _ = scheduler
    checks = {r.check: (r.ok, r.detail) for r in chains.verify_scheduler(tables).collect()}
    failed = {name for name, (ok, _) in checks.items() if not ok}
    assert failed == {
        "no duplicate (job_id, version_serial)", "active folders contain at least one job",
    }
    assert checks["active folders contain at least one job"][1] == "empty=1 total=5"
    assert checks["no duplicate (job_id, version_serial)"][1] == "dupes=2"
    assert checks["no orphan conditions"][1] == "orphan=0 total=23"
    assert len(checks) == 9
    keys = chains.verify_keys(tables)
    assert keys.filter("not ok").count() == 0 and keys.count() >= 9
    assert chains.verify_registry(tables).filter("not ok").count() == 0


def test_scheduler_replay_keeps_first_values(spark, scheduler):
    tables, sources, _ = scheduler
    later = RunClock("later", "2026-02-01 00:00:00")
    folders = sources["controlm_folders"].read(spark)
    moved = folders.withColumn(
        "data_center", F.when(F.col("folder_id") == "8001", "S9").otherwise(F.col("data_center"))
    )
    chains.load_table("controlm_folders", Source("frame", moved), tables, later)
    row = tables.read("job_folder").filter("folder_id = '8001'").first()
    assert str(row.created_at) == "2026-01-05 06:00:00" and str(row.last_seen_at) == "2026-02-01 00:00:00"
    trail = tables.read("runs_on").filter("folder_id = '8001'").orderBy("last_seen_at").collect()
    assert [(r.server, str(r.since)) for r in trail] == [
        ("S1", "2026-01-05 06:00:00"), ("S9", "2026-02-01 00:00:00"),
    ]
    assert tables.read("job_folder").count() == 6
    made = tables.read("job_folder_was_generated_by").filter("folder_id = '8001'")
    assert made.count() == 2


def test_structure_only_and_views(spark, tmp_path, scheduler):
    _, sources, _ = scheduler
    tables = TableSet(spark, str(tmp_path / "t"))
    results = chains.ingest_scheduler(tables, sources, CLOCK, from_views=True, structure_only=True)
    assert counts(results) == {"controlm_folders": (5, 0, 0), "controlm_jobs": (14, 0, 0)}
    assert not tables.exists("condition")
    assert {r.source for r in RunLog(tables).runs().collect()} == {"oracle"}


def test_stray_and_wrong_edges_are_found(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    frame = spark.createDataFrame
    tables.write("catalog_lob", frame([("L1",), ("L2",)], "lob_id string"))
    tables.write("product_line", frame([("P1",), (None,)], "product_line_id string"))
    links = [("L1", "P1"), ("L2", "P1"), ("L9", "P1"), ("L1", None), ("L9", "P9")]
    tables.write("has_product_line", frame(links, "lob_id string, product_line_id string"))
    # No employees at all, so these end nowhere; no rows, so nothing is found.
    tables.write("membership", frame([("m",)], "membership_id string"))
    tables.write("held_by", frame([("m", "e")], "membership_id string, employee_id string"))
    tables.write("has_product", frame([], "product_line_id string, product_id string"))
    found = {tuple(r) for r in chains.edge_findings(tables).collect()}
    assert found == {
        ("HAS_PRODUCT_LINE", None, "ProductLine", 1, "stray"),
        ("HAS_PRODUCT_LINE", "CatalogLOB", None, 1, "stray"),
        ("HAS_PRODUCT_LINE", None, None, 1, "stray"),
        ("HELD_BY", "Membership", None, 1, "stray"),
    }
    failed = {r.check: r.detail for r in chains.verify_registry(tables).filter("NOT ok").collect()}
    assert failed == {"edges end at nodes": "types=4 edges=4"}


def test_rows_without_the_parent_of_an_edge_are_kept(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    tables.write("catalog_lob", spark.createDataFrame([("L1",)], "lob_id string"))
    rows = [["P1", "one", "L1"], ["P2", "two", "L9"], ["P3", "three", "L9"]]
    source = Source("delimited", write_csv(tmp_path / "lines.csv", "product_line_id,name,parent_lob_id", rows))
    for _ in range(2):
        summary = chains.load_table("product_lines", source, tables, CLOCK)
        assert (summary.rows_processed, summary.rows_unmatched, summary.edges_unmatched) == (3, 0, 2)
        assert tables.read("product_line").count() == 3 and tables.read("has_product_line").count() == 1
        lost = tables.read("unmatched_row").collect()
        assert {(r.table, json.loads(r.row)["product_line_id"]) for r in lost} == {
            ("has_product_line", "P2"), ("has_product_line", "P3"),
        }
        assert len(lost) == 2


def test_view_columns_are_renamed(spark):
    from jobweave.sources.specs import project_view

    view = spark.createDataFrame([("1", "J", "C", "5", 0)], "table_id string, job_id string, "
                                 "condition string, isn_ string, _seq int")
    assert project_view(view, "controlm_conditions_in").columns == [
        "folder_id", "job_id", "condition_name", "isn", "_seq",
    ]


def test_unmatched_and_rejected_rows_are_kept(spark, tmp_path, scheduler):
    _, sources, _ = scheduler
    tables = TableSet(spark, str(tmp_path / "t"))
    jobs = sources["controlm_jobs"].read(spark)
    one = sources["controlm_folders"].read(spark).filter("folder_id = '8001'")
    chains.load_table("controlm_folders", Source("frame", one), tables, CLOCK)
    broken = jobs.withColumn(
        "version_serial", F.when(F.col("job_name") == "Q4_STEP5_RUN", "x").otherwise(F.col("version_serial"))
    )
    summary = chains.load_table("controlm_jobs", Source("frame", broken), tables, RunClock("j"))
    assert (summary.rows_processed, summary.rows_rejected, summary.rows_unmatched) == (13, 1, 11)
    assert tables.read("controlm_job").count() == 2
    bad = tables.read("rejected_row").first()
    assert bad.errors == ["version_serial:integer"] and json.loads(bad.raw)["job_name"] == "Q4_STEP5_RUN"
    assert tables.read("unmatched_row").count() == 11


def test_failed_load_is_logged(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "t"))
    rows = Source("frame", spark.createDataFrame([("1", "2", "3", "4")],
                  "folder_id string, job_id string, version_serial string, job_name string"))
    with pytest.raises(FileNotFoundError):
        chains.load_table("controlm_jobs", rows, tables, RunClock("bad"))  # no folders yet
    run = RunLog(tables).runs().first()
    assert (run.run_id, run.status) == ("bad", "FAILED")
    with pytest.raises(FileNotFoundError):
        chains.load_table("controlm_jobs", Source("delimited", str(tmp_path / "no.csv")), tables)


def test_reference_counts(reference):
    _, _, results, _ = reference
    assert counts(results) == {
        "catalog_lobs": (5, 1, 0),
        "product_lines": (3, 0, 0),
        "products": (3, 0, 0),
        "seal_applications": (2, 1, 0),
        "seal_contacts": (4, 1, 1),
        "dev_teams": (3, 0, 0),
    }
    assert results["snapshots"] == {
        "applications": {"new": 2, "unchanged": 0},
        "products": {"new": 4, "unchanged": 0},
        "catalog_lobs": {"new": 5, "unchanged": 0},
    }


def test_refresh_opens_with_the_active_segments(reference):
    _, _, results, _ = reference
    assert next(iter(results)) == "business_segments"
    assert results["business_segments"] == {"active_segments": 4, "codes": ["AWM", "CCB", "CIB", "Corp"]}


def test_reference_rows(reference):
    tables, _, _, _ = reference
    read = lambda name, key: {r[key]: r for r in tables.read(name).collect()}
    assert set(read("business_segment", "code")) == {"CCB", "CIB", "AWM", "Corp", "CB"}
    assert {(r.lob_id, r.segment_code, r.confidence) for r in tables.read("reconciles_to").collect()} == {
        ("N10", "AWM", 0.25), ("N30", "CIB", 0.9), ("N40", "CIB", 0.35), ("N50", "Corp", 0.6),
    }
    # the line with an unknown parent is a node without an edge
    assert set(read("product_line", "product_line_id")) == {"PL1", "PL2", "PL3"}
    assert set(read("has_product_line", "product_line_id")) == {"PL1", "PL2"}
    products = read("product", "product_id")
    assert products["P9"].name is None and products["P1"].orphan is False
    assert {(r.product_id, r.team_id) for r in tables.read("has_dev_team").collect()} == {
        ("P1", "T1"), ("P9", "T2"),
    }
    assert set(read("jira_board", "board_id")) == {"B1", "B3"}
    apps = read("application", "seal_id")
    assert apps["101"].sox_governed is False and apps["101"].sox_reportable is False
    assert apps["101"].hosting_vendor is None and apps["101"].description == "first\nsecond"
    assert apps["102"].sox_governed is None and apps["102"].status == "Build"
    assert tables.read("port").count() == 4 and tables.read("port").filter("active").count() == 0
    people = read("employee", "employee_id")
    assert people["E1"].full_name == "Ann Owner"  # the later position of the same row wins
    assert people["E3"].full_name == "Dan Three"
    assert people["E4"].full_name == "Cat Four" and people["E4"].email == "new@example.org"
    assert {r.membership_id for r in tables.read("membership").collect()} == {
        "101|SEAL|Application Owner|E1", "101|SEAL|CTO|E2", "101|SEAL|Primary Information Owner|E1",
        "102|SEAL|Application Owner|E3", "102|SEAL|CTO|E2",
        "101|SEAL|Backup Information Owner|E4", "101|SEAL|L2 Operate Manager|E3",
        "102|SEAL|Risk Manager|E4",
    }
    assert chains.verify_reference(tables).first().ok
    assert chains.verify_keys(tables).filter("not ok").count() == 0
    assert chains.verify_registry(tables).filter("not ok").count() == 0


def test_snapshot_state(reference):
    tables, _, _, _ = reference
    state = {r.entity_key: json.loads(r.state_json) for r in tables.read("application_snapshot").collect()}
    assert state["101"] == {
        "status": "Operate", "risk_level": "Low", "sox_governed": False, "deployment_module": None,
        "product_id": None, "dev_team_ids": [], "contact_ids": ["E1", "E2", "E3", "E4"],
    }
    lobs = {r.entity_key: json.loads(r.state_json) for r in tables.read("catalog_lob_snapshot").collect()}
    assert lobs["N30"] == {
        "code": "PAY", "name": "Payments", "product_line_ids": ["PL1"], "segment_codes": ["CIB"],
    }
    assert tables.read("application_has_version").count() == 2


def test_refresh_again_changes_nothing_but_what_changed(spark, reference):
    tables, sources, _, folder = reference
    some = {n: sources[n] for n in ("seal_applications", "seal_contacts")}
    again = chains.refresh_reference(tables, some, RunClock(loaded_at="2026-03-01 00:00:00"))
    assert again["snapshots"]["applications"] == {"new": 0, "unchanged": 2}
    changed = write_csv(
        folder / "lobs2.csv", "lob_id,code,name,reconciles_to_segment,reconcile_confidence",
        [["N50", "SHARED", "Renamed", "Corp", "0.6"]],
    )
    chains.load_table("catalog_lobs", Source("delimited", changed), tables)
    later = RunClock(loaded_at="2026-04-01 00:00:00")
    assert chains.write_snapshots(tables, later)["catalog_lobs"] == {"new": 1, "unchanged": 4}
    spans = tables.read("catalog_lob_snapshot").filter("entity_key = 'N50'").orderBy("valid_from").collect()
    assert [(str(r.valid_from), r.valid_to and str(r.valid_to)) for r in spans] == [
        ("2026-01-05", "2026-04-01"), ("2026-04-01", None),
    ]
    far = RunClock(loaded_at="2040-01-01 00:00:00")
    assert chains.prune_snapshots(tables, far) == {
        "application_snapshot": 0, "product_snapshot": 0, "catalog_lob_snapshot": 1,
    }
    assert tables.read("catalog_lob_snapshot").count() == 5


def test_missing_source_is_skipped(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "t"))
    results = chains.refresh_reference(
        tables, stage_sources(["catalog_lobs"], str(tmp_path)), CLOCK, snapshot=False
    )
    assert set(r["status"] for r in results.values()) == {"skipped"}
    assert set(results) == set(chains.REFERENCE_STAGES)


def test_vocabularies(spark, scheduler):
    tables, _, _ = scheduler
    terms = {r.source_label: r.terms for r in chains.term_counts(tables).collect()}
    assert terms["LocalClass"] == 14 and terms["LocalRelationship"] == 14
    assert sum(terms.values()) == 73 + 28 and terms["ProvProperty"] == 9
    roles = {r["name"]: r for r in tables.read("role").collect()}
    assert len(roles) == 13
    assert roles["Application Owner"].deprecated_name == "App Owner"
    assert str(roles["Backup Application Owner"].effective_from) == "2026-05-18"
    assert roles["Agility Lead"].mandatory is None
    assert tables.read("subclass_of").count() == 7
    # one wanted mapping has no published end and is never made
    assert tables.read("maps_to").count() == 6
    assert len(vocabulary.DECLARED_KEYS) == 33 and len(LOADS) == 11
    registry = vocabulary.edge_registry(spark)
    assert registry.count() == 15 and vocabulary.provenance_matrix(spark).count() == 9
    assert tables.read("in_dimension").count() == 10
    current = tables.read("has_business_segment")
    from jobweave.operators.history import active_segments

    assert tuple(active_segments(current).first()) == (4, ["AWM", "CCB", "CIB", "Corp"])


def test_rename_needs_a_free_name(spark):
    roles = spark.createDataFrame(
        [("App Owner", None, None), ("Application Owner", None, None), ("Data Owner", None, None)],
        "name string, deprecated_name string, spec_source string",
    )
    renamed = {r["name"]: r.deprecated_name for r in vocabulary.rename_roles(roles).collect()}
    assert renamed == {
        "App Owner": None, "Application Owner": None, "Primary Information Owner": "Data Owner",
    }


def test_bootstrap_twice_is_the_same(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "t"))
    chains.bootstrap(tables, supplements=())
    first = {n: tables.read(n).count() for n in tables.names()}
    chains.bootstrap(tables, supplements=())
    assert {n: tables.read(n).count() for n in tables.names()} == first
    assert first["role"] == 13 and first["dq_metric"] == 10


def test_ready_dependency_rows_can_be_loaded(spark, tmp_path, scheduler):
    source, sources, _ = scheduler
    tables = TableSet(spark, str(tmp_path / "t"))
    row = {
        "in_parent_table": "A", "in_job_name": "Q4_STEP5_RUN", "in_parent_table_id": "8004",
        "in_job_id": "5", "in_table_job_id": "8004.5", "out_condition": "C", "dependent_table": "B",
        "dependent_job": "Q2_STEP3_RUN", "dependent_table_id": "8002", "dependent_job_id": "3",
        "out_table_job_id": "8002.3", "recursion_level": "2", "dependency_path": "long",
    }
    rows = [row, {**row, "recursion_level": "1", "dependency_path": "short"},
            {**row, "in_job_id": "404"}, {**row, "recursion_level": "0"}]
    frame = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in row))
    results = chains.ingest_scheduler(
        tables, sources, CLOCK, dependencies=Source("frame", frame)
    )
    assert counts(results)["controlm_dependencies_derived"] == (3, 1, 1)
    edge = tables.read("was_informed_by").collect()
    assert [(e.recursion_level, e.dependency_path) for e in edge] == [(1, "short")]


def test_product_mapping_completes_the_application_state(spark, tmp_path, reference):
    from jobweave.plans.loads import PRODUCT_MAPPING, run_load

    source, sources, _, _ = reference
    tables = TableSet(spark, str(tmp_path / "t"))
    chains.load_table("seal_applications", sources["seal_applications"], tables, CLOCK)
    path = write_csv(
        tmp_path / "m.csv", "team_id,team_name,product_id,seal_ids",
        [["T1", "Pod One", "P2", "101, 102,101"], ["T2", "", "P1", "101"], ["T3", "None", "", "777"]],
    )
    rows = Source("delimited", path).read(spark)
    assert run_load(PRODUCT_MAPPING, rows, tables, CLOCK).rows_processed == 3
    assert {(r.seal_id, r.orphan) for r in tables.read("application").collect()} == {
        ("101", None), ("102", None), ("777", True),
    }
    states = {r.seal_id: r for r in chains.entity_states(tables)["applications"].collect()}
    assert (states["101"].product_id, states["101"].dev_team_ids) == ("P1", ["T1", "T2"])
    assert (states["777"].product_id, states["777"].dev_team_ids) == (None, ["T3"])


def test_unmatched_rows_that_tie_are_all_kept(spark, tmp_path, scheduler):
    _, sources, _ = scheduler
    tables = TableSet(spark, str(tmp_path / "t"))
    one = sources["controlm_folders"].read(spark).filter("folder_id = '8001'").drop("_seq")
    chains.load_table("controlm_folders", Source("frame", one), tables, CLOCK)
    # All jobs share one capture date; some have none.
    jobs = sources["controlm_jobs"].read(spark).drop("_seq").withColumn(
        "capture_date", F.when(F.col("job_id") == "2", F.lit(None)).otherwise("2026-01-02")
    )
    source = Source("frame", jobs, order_by="capture_date")
    summary = chains.load_table("controlm_jobs", source, tables, RunClock("ties"))
    lost = tables.read("unmatched_row")
    assert summary.rows_unmatched == lost.count() == 12
    names = {json.loads(r.row)["job_name"] for r in lost.collect()}
    assert len(names) == 12 and "Q1_STEP1_RUN" not in names
    # A replay of the same run replaces its rows.
    chains.load_table("controlm_jobs", source, tables, RunClock("ties"))
    assert tables.read("unmatched_row").count() == 12
