from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark: SparkSession):
    """Makes a table of documents from texts, (id, text) or whole rows."""
    def make(rows, schema=DOCS):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if not isinstance(r, tuple) else r
            full.append(r if len(r) > 2 else (r[0], r[1], None, "s", 0))
        return spark.createDataFrame(full, schema)

    return make
