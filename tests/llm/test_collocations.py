"""Collocations against counts of every phrase."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import collocations as co


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(n=400):
    r = random.Random(2)
    vocabulary = ["the", "The", "of", "new", "york", "city", "Élan", "élan", "a\u00a0b", "中文", "x\x00y", "-", *[f"w{i}" for i in range(30)]]
    phrases = ["new york city hall", "the quick brown fox jumps over", "one two three four five six seven", "a a a a a a"]
    for i in range(n):
        words = [r.choice(phrases) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?"]) for w in words)
        yield (r.choice(["en", "en", "en", "de", None, "und", ""]), text)
    yield from [("en", None), ("en", ""), ("en", " ,,. \t"), (None, "one two three four five six seven"), ("de", "new york " * 5_000)]


@pytest.mark.parametrize("budget", [co.BUDGET, 60, 5])
def test_counts_and_scores_are_the_brute_force_ones(spark, table, budget):
    docs = list(corpus())
    got = rows(co.collocations(table(docs, "lang string, text string"), least=8, top=25, budget=budget))
    assert got == co.brute_force(docs, 8, 25) and len(got) > 60


def test_chunks_of_any_size(spark, table, monkeypatch):
    docs = list(corpus(150))
    monkeypatch.setattr(co, "CHUNK", 200)
    assert rows(co.collocations(table(docs, "lang string, text string"), least=5, top=50, budget=30)) == co.brute_force(docs, 5, 50)


def test_sql_gives_the_same(spark, table, tmp_path):
    import duckdb

    docs = list(corpus(600))
    table(docs, "lang string, text string").write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(f"select lang, rank, phrase, a, l, r, n, score from ({co.ORACLE})").fetchall())
    assert rows(co.op13_collocations(spark.read.parquet(f"{tmp_path}/d"))) == want == co.brute_force(docs)


def test_a_pair_over_the_budget_is_dealt_out(spark, table):
    df = table([("en", "x y " * 3000)], "lang string, text string").select(F.col("lang"), F.col("text"))
    words = co.word_counts(df)
    assert {(r.word, r.n) for r in words.collect()} == {("x", 3000), ("y", 3000)}
    places = spark.createDataFrame([(int(h),) for h in co.word_hashes("en", ["x", "y"])], "place bigint")
    pairs = co.pair_counts(df, spark.sparkContext.broadcast(co._bitmap(places)))
    groups = co.Groups(pairs, 1000)
    assert groups.budget == 1000 and sorted(r.n for r in pairs.collect()) == [2999, 3000] and len(groups.over) == 2 and groups.spread == 6
    x, y = co.word_hashes("en", ["x", "y"])
    import numpy as np

    group, partial = groups(np.array([x, x, 5]), np.array([y, y, 6]), np.array([1, 2, 3]))
    assert partial.tolist() == [True, True, False] and group[0] != group[1]


def test_nodes_read_their_counts_from_leaves():
    t = pa.table({"lang": ["en", "de", "en"], "suffixes": [["a b c", "a b"], ["a b"], ["a b d e f", "b c"]], "partial": [[False] * 2, [False], [False] * 2], "n": [[3, 4], [5], [2, 1]]})
    got = sorted(tuple(r.values()) for r in co.subtree(t, 2).to_pylist())
    assert got == [("de", "a b", 2, 5), ("en", "a b", 2, 9), ("en", "a b c", 3, 3), ("en", "a b d", 3, 2), ("en", "a b d e", 4, 2), ("en", "a b d e f", 5, 2)]


def test_products_beyond_64_bits(spark):
    exact = spark.sql("select cast(1000 as decimal(4, 0)) * cast(30000000000000 as decimal(17, 0)) * cast(90000000000000 as decimal(17, 0)) div (cast(40000000000000 as decimal(19, 0)) * cast(70000000000000 as decimal(19, 0))) as x")
    assert exact.first().x == 1000 * 30000000000000 * 90000000000000 // (40000000000000 * 70000000000000)


def test_empty_table_and_clashing_columns(spark, table):
    assert co.op13_collocations(table([], "lang string, text string")).count() == 0
    df = table([("en", "a b " * 200)], "lang string, text string")
    for name in ("grp", "n", "phrase", "word", "suffix", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    assert rows(co.op13_collocations(df)) == co.brute_force([("en", "a b " * 200)])
