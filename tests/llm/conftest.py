import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, range string, _bucket string"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of (doc_id, text) pairs among columns whose names operators use themselves."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, len(t or ""), 1, "r", "b") for i, t in rows]
        return spark.createDataFrame(full, T._parse_datatype_string(DOCS))

    return make


sys.path.insert(0, str(Path(__file__).parent))
