from collections import Counter
import random

import pytest
from estate import ANCHOR, walked, write_scheduler
from pyspark.sql import functions as F

from jobweave.operators import closure
from jobweave.plans.chains import scheduler_rows, SCHEDULER_STAGES
from jobweave.operators.validate import split_rows
from jobweave.sources import specs
from jobweave.sources.readers import stage_sources

LINK = ", ".join(
    f"{c} {'bigint' if c == 'version_serial' else 'string'}" for c in closure.LINK_COLUMNS
)


def links(spark, pairs, cyclic=None):
    """(condition, job name, job id) triples as link rows of one folder."""
    rows = [(c, "F", "1", job, jid, (cyclic or {}).get(jid), 1) for c, job, jid in pairs]
    return spark.createDataFrame(rows, LINK)


def brute_force(consumes, produces, guard, max_level=10, anchor=lambda r: True):
    """The walk, one row at a time."""
    need = sorted({tuple(r) for r in consumes})
    make = sorted({tuple(r) for r in produces})
    inside = (lambda path, n: n in path) if guard == "substring" else (
        lambda path, n: n in path.split(" -> ")
    )
    level, out = [], []
    for c, job, jid in need:
        if anchor((c, job, jid)):
            for c2, p, pid in make:
                if c == c2 and job != p:
                    level.append((job, jid, c, p, pid, 1, f"{job} -> {p}"))
    while level:
        out += level
        step = []
        for job, jid, _, at, _, n, path in level:
            if n >= max_level:
                continue
            for c, consumer, _ in need:
                if consumer != at:
                    continue
                for c2, p, pid in make:
                    if c == c2 and consumer != p and not inside(path, p):
                        step.append((job, jid, c, p, pid, n + 1, f"{path} -> {p}"))
        level = step
    return sorted(out)


def as_tuples(paths):
    return sorted(
        tuple(r)
        for r in paths.select(
            "in_job_name", "in_job_id", "out_condition", "dependent_job", "dependent_job_id",
            "recursion_level", "dependency_path",
        ).collect()
    )


def edges_of(rows):
    best = {}
    for _, jid, c, _, pid, n, path in rows:
        key = (jid, pid, c)
        best[key] = min(best.get(key, (n, path)), (n, path))
    return {(*k, *v) for k, v in best.items()}


def edge_tuples(edges):
    return {
        (r.in_job_id, r.dependent_job_id, r.out_condition, r.recursion_level, r.dependency_path)
        for r in edges.collect()
    }


def random_graph(seed, jobs=7, shared_names=True):
    rng = random.Random(seed)
    # Names include one that is part of another, and one shared by two jobs.
    names = ["A", "AB", "C", "D", "E", "C" if shared_names else "G", "F"][:jobs]
    ids = [str(i) for i in range(jobs)]
    produces = [(f"c{i}", names[i], ids[i]) for i in range(jobs)]
    produces += [(f"c{rng.randrange(jobs)}", names[i], ids[i]) for i in range(jobs) if rng.random() < 0.3]
    consumes = [
        (f"c{j}", names[i], ids[i]) for i in range(jobs) for j in rng.sample(range(jobs), 2)
    ]
    return consumes, produces


@pytest.mark.parametrize("guard", ["substring", "exact"])
@pytest.mark.parametrize("seed", range(3))
def test_paths_and_edges_match_brute_force(spark, seed, guard):
    consumes, produces = random_graph(seed)
    need, make = links(spark, sorted(set(consumes))), links(spark, sorted(set(produces)))
    expected = brute_force(consumes, produces, guard, max_level=5)
    paths = closure.dependency_paths(need, make, max_level=5, guard=guard)
    assert as_tuples(paths) == expected
    assert edge_tuples(closure.shortest_edges(paths)) == edges_of(expected)
    direct = closure.dependency_edges(need, make, max_level=5, guard=guard)
    assert edge_tuples(direct) == edges_of(expected)


@pytest.mark.parametrize("guard", ["substring", "exact"])
def test_many_cyclic_graphs_at_once(spark, guard):
    """Detours, names inside others and anchors, on graphs that share no name."""
    consumes, produces = [], []
    for seed in range(24):
        rng = random.Random(seed)
        # In odd graphs one name lies inside another; in even ones a name has two jobs.
        names = ["A", "B", "BA" if seed % 2 else "C", "D", "E", "D"]
        size = len(names)
        own = [f"G{seed:02d}_{n}" if n != "BA" else f"G{seed:02d}_BX" for n in names]
        ids = [f"{seed}.{i}" for i in range(size)]
        produces += [(f"c{seed}.{i}", own[i], ids[i]) for i in range(size)]
        produces += [(f"d{seed}.{rng.randrange(3)}", own[i], ids[i]) for i in range(size) if rng.random() < 0.6]
        consumes += [(f"c{seed}.{j}", own[i], ids[i]) for i in range(size) for j in rng.sample(range(size), 1)]
        consumes += [(f"d{seed}.{rng.randrange(3)}", own[i], ids[i]) for i in range(size)]
    need, make = links(spark, sorted(set(consumes))), links(spark, sorted(set(produces)))
    expected = edges_of(brute_force(consumes, produces, guard, max_level=6))
    assert edge_tuples(closure.dependency_edges(need, make, max_level=6, guard=guard)) == expected
    some = F.when(F.substring_index("job_id", ".", -1) < "3", "G1").otherwise("H1")
    anchored = closure.dependency_edges(
        need.withColumn("folder", some), make, max_level=6, guard=guard, anchor_like="G%"
    )
    assert edge_tuples(anchored) == {e for e in expected if e[0].split(".")[1] < "3"}


def test_names_that_meet_an_arrow_are_walked(spark):
    consumes = [("a", "S", "1"), ("b", "M", "2"), ("c", "N", "3")]
    produces = [("a", "M", "2"), ("b", "-", "4"), ("b", "N", "3"), ("c", "T ", "5"), ("c", "T", "6")]
    expected = edges_of(brute_force(consumes, produces, "substring"))
    found = closure.dependency_edges(links(spark, consumes), links(spark, produces))
    assert edge_tuples(found) == expected


def test_anchored_walk_equals_filtered_walk(spark):
    consumes, produces = random_graph(5)
    need, make = links(spark, sorted(set(consumes))), links(spark, sorted(set(produces)))
    need = need.withColumn("folder", F.when(F.col("job_id") < "3", "G1").otherwise("H1"))
    everything = closure.dependency_paths(need, make, max_level=6)
    shown = [(r.in_job_name, r.recursion_level) for r in closure.in_display_order(everything).collect()]
    assert shown == sorted(shown) and len(shown) == everything.count()
    expected = as_tuples(everything.filter("in_parent_table = 'G1'"))
    assert as_tuples(closure.dependency_paths(need, make, anchor_folders=["G1"], max_level=6)) == expected
    assert as_tuples(closure.dependency_paths(need, make, anchor_like="G%", max_level=6)) == expected


@pytest.mark.parametrize("max_level, depth", [(10, 10), (1, 1), (3, 3), (7, 7), (30, 11)])
def test_chain_is_capped(spark, max_level, depth):
    names = [f"JOB_{i:02d}" for i in range(12)]
    make = links(spark, [(f"c{i}", n, str(i)) for i, n in enumerate(names)])
    need = links(spark, [(f"c{i + 1}", n, str(i)) for i, n in enumerate(names[:-1])])
    paths = closure.dependency_paths(need, make, max_level=max_level)
    assert paths.agg(F.max("recursion_level")).first()[0] == depth
    assert paths.count() == sum(12 - k for k in range(1, depth + 1))
    assert closure.dependency_edges(need, make, max_level=max_level).count() == paths.count()


def test_cycles_and_self_loops_end(spark):
    make = links(spark, [("a", "A1", "1"), ("b", "B1", "2")])
    need = links(spark, [("b", "A1", "1"), ("a", "B1", "2"), ("a", "A1", "1")])
    paths = closure.dependency_paths(need, make)
    assert as_tuples(paths) == [
        ("A1", "1", "b", "B1", "2", 1, "A1 -> B1"), ("B1", "2", "a", "A1", "1", 1, "B1 -> A1"),
    ]


def test_no_dependencies(spark):
    make = links(spark, [("a", "A", "1")])
    need = links(spark, [("z", "B", "2")])
    assert closure.dependency_paths(need, make).count() == 0
    assert closure.dependency_edges(need, make).count() == 0
    assert closure.dependency_paths(need, make, anchor_folders=["F"]).count() == 0


def test_substring_guard_prunes_more(spark):
    make = links(spark, [("x", "LOAD_ALL", "1"), ("y", "LOAD", "2")])
    need = links(spark, [("x", "START", "0"), ("y", "LOAD_ALL", "1")])
    assert closure.dependency_paths(need, make).count() == 2
    assert closure.dependency_paths(need, make, guard="exact").count() == 3
    with pytest.raises(ValueError):
        closure.dependency_paths(need, make, guard="none")


def test_cyclic_type_option(spark):
    make = links(spark, [("x", "P", "1")], {"1": "I"})
    need = links(spark, [("x", "Q", "2"), ("x", "R", "3")], {"2": "I", "3": "C"})
    assert closure.dependency_paths(need, make).count() == 2
    assert closure.dependency_paths(need, make, match_cyclic=True).count() == 1


def test_matches_recursive_sql(spark):
    consumes, produces = random_graph(9, shared_names=False)
    need, make = links(spark, sorted(set(consumes))), links(spark, sorted(set(produces)))
    closure.direct_dependencies(need, make).createOrReplaceTempView("hop")
    walked = spark.sql(
        """
        WITH RECURSIVE walk AS (
          SELECT in_job_id, dependent_job_id, dependent_job, out_condition, 1 AS level,
                 concat(in_job_name, ' -> ', dependent_job) AS path FROM hop
          UNION ALL
          SELECT w.in_job_id, h.dependent_job_id, h.dependent_job, h.out_condition, w.level + 1,
                 concat(w.path, ' -> ', h.dependent_job)
          FROM walk w JOIN hop h ON h.in_job_name = w.dependent_job
          WHERE w.level < 5 AND instr(w.path, h.dependent_job) = 0)
        SELECT in_job_id, dependent_job_id, out_condition, level, path FROM walk
        """
    )
    paths = closure.dependency_paths(need, make, max_level=5)
    ours = paths.select(
        "in_job_id", "dependent_job_id", "out_condition", "recursion_level", "dependency_path"
    )
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, walked.collect()))


@pytest.fixture(scope="module")
def estate_links(spark, tmp_path_factory):
    folder = write_scheduler(tmp_path_factory.mktemp("estate"))
    rows = scheduler_rows(stage_sources(SCHEDULER_STAGES, str(folder)), spark, drop_inactive=False)
    typed = {n: split_rows(rows[n], specs.SPECS[n]).accepted.drop("_seq") for n in SCHEDULER_STAGES}
    jobs, folders = typed["controlm_jobs"], typed["controlm_folders"]
    return (
        closure.job_links(jobs, folders, typed["controlm_conditions_in"]),
        closure.job_links(jobs, folders, typed["controlm_conditions_out"]),
        typed,
    )


def by_level(frame):
    return {r.recursion_level: r["count"] for r in frame.groupBy("recursion_level").count().collect()}


def expected_levels(paths):
    """(paths by level, edges by their least level) of walked paths."""
    least = {}
    for path in paths:
        ends = path[0], path[-1]
        least[ends] = min(least.get(ends, len(path)), len(path))
    return Counter(len(p) - 1 for p in paths), Counter(n - 1 for n in least.values())


def test_levels_of_the_estate(estate_links):
    consumes, produces, _ = estate_links
    by_path, by_edge = expected_levels(walked())
    paths = closure.dependency_paths(consumes, produces)
    assert by_level(paths) == by_path and max(by_path) == 3
    assert tuple(paths.columns) == closure.DEPENDENCY_COLUMNS
    assert by_level(closure.shortest_edges(paths)) == by_edge
    assert by_level(closure.dependency_edges(consumes, produces)) == by_edge


def test_levels_of_one_folder(estate_links):
    consumes, produces, _ = estate_links
    # An anchored walk gives the paths from the anchor's jobs.
    by_path, by_edge = expected_levels(walked([4]))
    paths = closure.dependency_paths(consumes, produces, anchor_folders=[ANCHOR])
    assert by_level(paths) == by_path
    assert by_level(closure.shortest_edges(paths)) == by_edge
    row = paths.filter("recursion_level = 3").first()
    assert row.in_table_job_id.startswith("8004.") and row.dependency_path.count(" -> ") == 3


def test_links_follow_active_folders_versions_and_sign(spark, estate_links):
    _, _, typed = estate_links
    jobs, folders = typed["controlm_jobs"], typed["controlm_folders"]
    out = typed["controlm_conditions_out"]
    assert closure.job_links(jobs, folders, out).count() == 14
    idle = folders.withColumn(
        "user_daily", F.when(F.col("folder_id") == "8003", " ").otherwise(F.col("user_daily"))
    )
    assert closure.job_links(jobs, idle, out).count() == 10
    assert closure.job_links(jobs.withColumn("version_serial", F.lit(9)), folders, out).count() == 0
    removing = out.withColumn("sign", F.lit("-"))
    assert closure.job_links(jobs, folders, removing).count() == 14
    assert closure.job_links(jobs, folders, removing, only_posting=True).count() == 0


def test_two_versions_of_a_job_are_two_rows(spark):
    row = [("x", "F", "1", "P", "1", None, 1), ("x", "F", "1", "P", "1", None, 2)]
    make = spark.createDataFrame(row, LINK)
    need = links(spark, [("x", "Q", "2")])
    assert closure.dependency_paths(need, make).count() == 2
    assert closure.dependency_edges(need, make).count() == 1


@pytest.mark.parametrize("anchored", [False, True])
def test_many_graphs_of_names_inside_one_another(spark, anchored):
    """Dense graphs in which names hold several others, with cycles and shared names."""
    consumes, produces = [], []
    for seed in range(30):
        rng = random.Random(100 + seed)
        own = [f"{seed:02d}{n}" for n in ("A", "AB", "ABC", "BAB", "C", "ABC", "D")]
        if seed % 3 == 0:
            own = [f"{n}{seed:02d}" for n in ("X", "YX", "ZYX", "V", "ZYX", "WZYX", "W")]
        size, ids = len(own), [f"{seed}.{i}" for i in range(len(own))]
        produces += [(f"c{seed}.{i}", own[i], ids[i]) for i in range(size)]
        consumes += [(f"c{seed}.{j}", own[i], ids[i]) for i in range(size) for j in rng.sample(range(size), 2 + seed % 2)]
    need, make = links(spark, sorted(set(consumes))), links(spark, sorted(set(produces)))
    expected = edges_of(brute_force(consumes, produces, "substring", max_level=6))
    if anchored:
        some = F.when(F.substring_index("job_id", ".", -1) < "2", "G1").otherwise("H1")
        need = need.withColumn("folder", some)
        expected = {e for e in expected if e[0].split(".")[1] < "2"}
    found = closure.dependency_edges(need, make, max_level=6, anchor_like="G%" if anchored else None)
    assert edge_tuples(found) == expected


def test_layers_of_nested_names_do_not_multiply(spark):
    """Each job needs all of the next layer: 4 ** 9 paths, but few places to stand at."""
    layers = [[f"L{i}_{'x' * k}" for k in range(1, 5)] for i in range(10)]
    need = [(n, job, job) for here, there in zip(layers, layers[1:]) for job in here for n in there]
    make = [(job, job, job) for layer in layers for job in layer]
    edges = closure.dependency_edges(links(spark, need), links(spark, make))
    assert edges.count() == 16 * sum(range(1, 10))


def test_names_inside_others(spark):
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(0, 9))) for _ in range(150)} | {"é", "xéy"})
    found = closure._names_inside(spark.createDataFrame([(n,) for n in names], "name string"))
    expected = {(a, b) for a in names for b in names if b and a != b and b in a}
    rows = [tuple(r) for r in found.select("_outer", "_inner").collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 100


def staged_parts(spark, monkeypatch, make):
    """The parts that closure writes while ``make`` runs."""
    parts = []
    write = closure.StagedFolder.write

    def noted(folder, df, part):
        parts.append(part)
        return write(folder, df, part)

    monkeypatch.setattr(closure.StagedFolder, "write", noted)
    return make(), parts


def test_visits_of_plain_names_are_edges_as_they_are(spark, monkeypatch):
    """No grouping of all edges where all who wait for a name wait for it alike, and none to look for names inside."""
    consumes = [("a", "S1", "1"), ("b", "M1", "2"), ("c", "N1", "3"), ("b", "S1", "1")]
    produces = [("a", "M1", "2"), ("b", "N1", "3"), ("c", "T1", "4"), ("c", "T1", "5")]
    expected = edges_of(brute_force(consumes, produces, "substring"))
    need, make = links(spark, consumes), links(spark, produces)
    for anchor in (None, "F%"):
        edges, parts = staged_parts(
            spark, monkeypatch, lambda: closure.dependency_edges(need, make, anchor_like=anchor)
        )
        assert edge_tuples(edges) == expected
        assert "found" not in parts and "barred/_level=1" not in parts


def test_names_reached_by_several_conditions_and_jobs_of_several_names(spark):
    consumes = [("a", "S1", "1"), ("b", "S1", "1"), ("b", "M1", "2"), ("c", "M1", "2"), ("a", "S2", "1"), ("d", "N1", "3")]
    produces = [("a", "M1", "2"), ("b", "N1", "3"), ("c", "N1", "3"), ("c", "N2", "3"), ("d", "M1", "9"), ("d", "S1", "1")]
    for guard in ("substring", "exact"):
        expected = edges_of(brute_force(consumes, produces, guard))
        found = closure.dependency_edges(links(spark, consumes), links(spark, produces), guard=guard)
        assert edge_tuples(found) == expected
        assert found.count() == len(expected)
