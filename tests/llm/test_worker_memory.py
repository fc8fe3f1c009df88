"""What a worker holds at once does not grow with its split."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from jobweave.llm import packing
from jobweave.llm.common import SLICE_ROWS
from jobweave.llm.tokens import ByteTokenizer


def test_packed_pieces_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    texts = ["word " * (700 + i % 300) for i in range(1500)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    out = list(packing._packed(ByteTokenizer.default_path(), 1024, 0)([rows]))
    longest = max(len(ids) for batch in out for ids in batch.column("ids").to_pylist())
    assert longest <= 4 * 1024
    assert max(batch.num_rows for batch in out) <= 512
    assert sorted({i for batch in out for i in batch.column("id").to_pylist()}) == list(range(len(texts)))


def test_stages_send_rows_in_slices(spark, documents):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        corpus_pipeline.pack_windows(spark, documents([(1, "a text")]), "")
        assert int(spark.conf.get(name)) == SLICE_ROWS
    finally:
        spark.conf.set(name, before)
