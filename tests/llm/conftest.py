import os

import pytest

TEXT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def corpus(spark):
    """Rows (doc_id, text[, lang, source]) as a table of documents, with a clashing column."""

    def make(rows, **extra):
        full = [(*r, *[None] * (4 - len(r)), None) for r in rows]
        df = spark.createDataFrame(full, TEXT)
        from pyspark.sql import functions as F

        for name in ("score", "norm", "hash", "bands", "id", "component", "size", "bucket", "label", "target"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def tiny():
    return os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")
