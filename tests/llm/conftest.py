from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHES = ("node", "hash", "sha", "key", "component", "kept", "row", "value", "values", "keep_id", "epoch", "toxic")
LONG = " ".join(f"word{k}" for k in range(30_000))
ROWS = [
    (1, "the same text of more than five words", "en", "src1", 3),
    (2, "the same text of more than five words", "en", "src0", None),
    (3, "The SAME text of more\tthan five words", None, "src0", 3),
    (3, "The SAME text of more\tthan five words", None, "src0", 3),
    (4, "", "en", "src2", 0),
    (5, None, "de", None, None),
    (6, " \n\t", None, None, None),
    (7, "one two", "en", "other", 7),
    (8, "ONE\ntwo", "fr", "src4", 7),
    (9, LONG, "en", "src0", 9),
    (10, LONG + " tail", "en", "src0", 9),
    (11, "é😀 mail me: ann@example.org, 10.0.0.1\n+1 (212) 555-0101", "fr", "src5", 1),
    (None, "a row without an id that has some words", "en", "src0", 1),
    (None, None, None, None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
