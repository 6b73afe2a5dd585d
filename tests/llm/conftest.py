import json

import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Rows as a table, with extra columns whose names clash with those that the operators add."""

    def make(rows, schema="doc_id bigint, text string", extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "n_words", "shard", "size", "label", "key", "items"):
                if name not in df.columns:
                    df = df.withColumn(name, F.lit("x"))
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    import random

    def text(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))

    return text


ODD = [(9001, None), (9002, ""), (9003, "   \n\t "), (9004, "x" * 50_000), (9005, "ü ß é 中文 \U0001f600"), (9006, "one"), (9006, "one"), (None, "one two three four five six")]


@pytest.fixture
def odd():
    return list(ODD)
