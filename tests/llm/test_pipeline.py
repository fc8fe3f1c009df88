"""The five stages over whole small tables, and the registered queries beside their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from jobweave.llm import language, personal, queries, toxicity
from jobweave.llm.tokens import ByteTokenizer
from llm_cases import ODD
from test_minhash import brute_parts, runs

FOLDER = "/root/testdata/sf0.001"


def plain_stages(spark, docs, labels):
    """{id: text} after each of the first four stages, row by row but for the fitting of models."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    frame = lambda kept: spark.createDataFrame(docs.filter(F.col("doc_id").isin(list(kept))).collect(), docs.schema)
    model = language.train(docs)
    found = {i: model.predict(t) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if found[i][0] != "und" and found[i][1] >= 0.5}
    yield texts
    judge, _ = toxicity.fit(frame(texts), labels, "doc_id", "text", "toxic", 5, 0, toxicity.ORDER)
    texts = {i: t for i, t in texts.items() if not judge.toxic(t)}
    yield texts
    parts = brute_parts({i: runs(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if parts[i] == i}
    yield texts
    yield {i: personal.redacted(t) for i, t in texts.items()}


def test_run_equals_plain_stages(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    expected = list(plain_stages(spark, docs, labels))
    kept = docs
    for (name, stage), texts in zip(corpus_pipeline.STAGES, expected):
        before = kept.count()
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert {r.doc_id: r.text for r in rows} == texts and len(rows) == len(texts)
        assert name != "near_duplicates" or len(rows) < before
        assert all(r.n_chars == len(r.text) for r in rows)
        kept = spark.createDataFrame(rows, docs.schema)

    encode, pieces = ByteTokenizer.shared(ByteTokenizer.default_path()).encode_exact, {}
    for r in corpus_pipeline.run(spark, FOLDER).orderBy("doc_id", "start").collect():
        assert r.start == len(pieces.get(r.doc_id, [])) and r.length * 4 == len(r.ids)
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert pieces == {i: [*encode(t).tolist(), 0] for i, t in expected[-1].items()}


STAGES = dict(corpus_pipeline.STAGES)


def test_stages_on_odd_rows(spark, documents):
    """Nulls, repeated ids, columns named like the operators' own, and an empty table."""
    odd = documents([*ODD, (6, "other text of a repeated id"), (11, "mail me at jo@example.org now " * 2000)])
    labels = spark.createDataFrame([(4, 0), (5, 1), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    words = {"en": "the quick brown fox and the lazy dog", "de": "der schnelle braune Fuchs und der Hund"}
    known = [(100 + i, w + f" {i}", lang) for i, (lang, w) in enumerate([*words.items()] * 20)]
    for name, stage in STAGES.items():
        nothing = stage(spark, odd.limit(0), FOLDER)
        assert nothing.isEmpty() and (name == "packing" or nothing.columns == odd.columns)
    model = language.train(spark.createDataFrame(known, "doc_id bigint, text string, lang string"))
    kept = language.drop_unidentified(odd, model, least_score=0.0).collect()
    assert all(any(c.isalpha() for c in r.text) for r in kept) and len(kept) >= 8
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()
    distinct = STAGES["near_duplicates"](spark, odd, FOLDER)
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in distinct.collect()) == [
        (1, ""), (4, "word"), (5, "one t"), (6, "other"), (6, "xxxxx"), (7, "12345"), (8, "A.\nB."), (11, "mail ")
    ]
    masked = STAGES["personal_data"](spark, odd, FOLDER)
    assert masked.count() == odd.count()
    assert not any("jo@example.org" in (r.text or "") for r in masked.collect())
    packed = STAGES["packing"](spark, odd, FOLDER)
    assert packed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_every_row_is_judged_by_its_own_text(spark):
    """A toxic text goes whatever its id; a clean one with the same id stays."""
    rows = [(i, ("vile scum filth " if i % 2 else "kind warm words ") * 30, i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels, texts = docs.select("doc_id", "toxic"), docs.select("doc_id", "text")
    more = spark.createDataFrame(
        [(None, rows[1][1]), (None, rows[0][1]), (0, rows[1][1]), (1, rows[0][1])], texts.schema
    )
    kept = toxicity.drop_toxic(texts.unionAll(more), labels).collect()
    assert {r.text for r in kept} == {rows[0][1]}
    assert len(kept) == 102 and sum(r.doc_id is None for r in kept) == 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "embeddings"):
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame, expected = contract.queries()[name](spark, FOLDER), database.sql(contract.oracle_sql()[name])
    order = sorted(frame.columns)
    assert order == sorted(expected.columns)
    ours = sorted(str(tuple(r[c] for c in order)) for r in frame.collect())
    theirs = sorted(str(tuple(r[expected.columns.index(c)] for c in order)) for r in expected.fetchall())
    assert ours == theirs and ours
