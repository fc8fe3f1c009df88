import pytest
from estate import write_csv

from jobweave.sinks.tables import TableSet
from jobweave.sources import files
from jobweave.sources.readers import (
    JdbcQuery, Source, literal_table, read_delimited, stage_sources,
)


def test_headers_bom_quotes_and_ragged_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(
        "﻿ ID , Name,Note\r\n1,\"a,b\",\"two\nlines \"\"q\"\"\"\r\n2,short\r\n3,c,d,surplus\r\n".encode()
    )
    frame = read_delimited(spark, str(path))
    assert frame.columns == ["id", "name", "note", "_seq"]
    rows = [tuple(r)[:3] for r in frame.orderBy("_seq").collect()]
    assert rows == [("1", "a,b", 'two\nlines "q"'), ("2", "short", ""), ("3", "c", "d")]


def test_unquoted_commas_shift_but_do_not_fail(spark, tmp_path):
    path = tmp_path / "y.csv"
    path.write_text("a|b\n1|x|y\n")
    assert read_delimited(spark, str(path), delimiter="|").first().b == "x"


def test_empty_cells_stay_empty_text(spark, tmp_path):
    path = write_csv(tmp_path / "z.csv", "a,b", [["1", ""], [" 2 ", "[Null]"]])
    assert [tuple(r)[:2] for r in read_delimited(spark, path).orderBy("_seq").collect()] == [
        ("1", ""), (" 2 ", "[Null]"),
    ]


def test_sources_are_interchangeable(spark, tmp_path):
    path = write_csv(tmp_path / "s.csv", "A,B", [["1", "x"], ["2", "y"]])
    csv_rows = Source("delimited", path).read(spark)
    csv_rows.drop("_seq").write.parquet(str(tmp_path / "s.parquet"))
    csv_rows.createOrReplaceTempView("s_view")
    for source in (
        Source("parquet", str(tmp_path / "s.parquet"), order_by="a"),
        Source("table", "s_view"),
        Source("frame", csv_rows),
    ):
        assert source.exists(spark)
        assert {(r.a, r.b) for r in source.read(spark).collect()} == {("1", "x"), ("2", "y")}
    assert not Source("delimited", str(tmp_path / "none.csv")).exists(spark)
    with pytest.raises(ValueError):
        Source("carrier pigeon", None).read(spark)


def test_jdbc_options():
    plain = JdbcQuery("jdbc:x", "select 1 ;\n", user="u", password="pw")
    assert plain.options() == {
        "url": "jdbc:x", "fetchsize": "1000", "user": "u", "password": "pw", "query": "select 1",
    }
    assert "pw" not in repr(plain)
    split = JdbcQuery("jdbc:x", "select 1", partition_column="id", lower_bound=0, upper_bound=9,
                      num_partitions=3).options()
    assert split["dbtable"] == "(select 1) source" and "query" not in split
    chosen = stage_sources(["a", "b"], queries={"a": plain})
    assert list(chosen) == ["a"] and chosen["a"].kind == "jdbc"
    assert stage_sources(["a"], "/in")["a"].location == "/in/a.csv"


def test_each_stage_has_its_own_options_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;n\n2;x\n10;y\n1;z\n")
    (tmp_path / "b.csv").write_text("k,n\n1,p\n2,q\n")
    sources = stage_sources(
        ["a", "b", "c"], str(tmp_path), queries={"c": JdbcQuery("u", "select 1")},
        options={"a": {"delimiter": ";"}, "b": {"multi_line": False}, "c": {"fetch_size": 7}}, order_by={"a": "n"},
    )
    assert [s.kind for s in sources.values()] == ["delimited", "delimited", "jdbc"]
    assert sources["c"].options == {"fetch_size": 7}
    rows = lambda name, by: [r.k for r in sources[name].read(spark).orderBy(by).collect()]
    assert rows("a", "_seq") == ["2", "10", "1"] and rows("b", "_seq") == ["1", "2"]
    assert list(stage_sources(["a", "b"], queries={})) == []
    with pytest.raises(ValueError, match="no such stage: d"):
        stage_sources(["a"], "/in", options={"d": {}})


def test_versioned_tables(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "t"))
    assert not tables.exists("n") and tables.read_or_none("n") is None
    with pytest.raises(FileNotFoundError):
        tables.read("n")
    tables.write("n", spark.range(2))
    tables.write("n", tables.read("n").union(spark.range(5, 6)))
    assert tables.current_version("n") == 2 and tables.read("n").count() == 3
    (tmp_path / "t" / "n" / "version=000003").mkdir()  # an interrupted write
    assert tables.read("n").count() == 3
    tables.append("n", spark.range(9, 10))
    assert tables.current_version("n") == 4 and tables.read("n").count() == 4
    assert tables.names() == ["n"]


def test_staging_uses_the_shared_folder(spark, monkeypatch):
    staged = files.StagedFolder(spark, "x")
    frame, rows = staged.write(spark.range(7), "part")
    assert rows == 7 and frame.count() == 7
    assert staged.root.startswith(files.shared_folder(spark))


def test_literal_table_has_a_known_size(spark):
    frame = literal_table(spark, [("a", 1), ("b", None)], "n string, v int")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan
    assert [tuple(r) for r in frame.collect()] == [("a", 1), ("b", None)]
