from __future__ import annotations

import pytest
from conftest_llm import SCHEMA, corpus
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """The same rows with columns whose names an operator might use itself, or
    that differ from its own by case only."""
    extra = {c: F.lit("x") for c in ("TEXT", "Doc_Id", "fp", "row", "_row", "size", "start", "sid", "kept", "spans", "n_words", "key", "label", "_c0", "u")}
    out = docs
    for n, c in extra.items():
        out = out.select("*", c.alias(n))
    return out
