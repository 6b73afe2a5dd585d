"""The filter audit against every order applied to every document."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from folioscope.llm import filteraudit as fa


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def texts(n):
    r = random.Random(4)
    for i in range(n):
        words = [r.choice("abcdefghij") * r.randint(1, 9) for _ in range(r.choice([0, 5, 150, 199, 200, 230, 300]))]
        if r.random() < 0.4:
            words = [f"{w}{k}" for k, w in enumerate(words)]
        text = r.choice([" ", "\n", " \t "]).join(words)
        yield text.upper() if r.random() < 0.2 else f"{text} {r.choice('#$%&*|')}" if r.random() < 0.3 else text


def corpus():
    made = list(texts(60))
    docs = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(made)]
    docs += [(1000 + i, made[i % 7], "en") for i in range(40)]  # copies
    docs += [(5, made[5], "de"), (5, made[5], "de"), (5, made[9], "de")]  # repeated rows, one doc_id with two texts
    docs += [(None, made[3], "en"), (None, None, None), (2000, None, "fr"), (2001, "", "fr"), (2002, "\u00a0\u2003x \U0001f600A" * 300, "fr"), (2003, "w " * 50_000, "fr")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 1040, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1), (2000, 1, 0), (9999, 1, 1)]
    return docs, labels


def test_every_order_is_the_brute_force_one(spark, table):
    docs, labels = corpus()
    got = rows(fa.op12_filter_audit(table(docs, "doc_id bigint, text string, lang string"), table(labels, "doc_id bigint, quality int, toxic int")))
    assert len(got) == 4 * 600 and got == sorted(fa.brute_force(docs, labels))


def test_sql_gives_the_same(spark, table, tmp_path):
    import duckdb

    docs, labels = corpus()
    docs = [d for d in docs if d[0] is not None]
    d, b = table(docs, "doc_id bigint, text string, lang string"), table(labels, "doc_id bigint, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/d")
    b.write.parquet(f"{tmp_path}/l")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/d/*.parquet'")
    con.sql(f"create view labels as from '{tmp_path}/l/*.parquet'")
    got = fa.op12_filter_audit(d, b)
    assert sorted(con.sql(f"select {', '.join(got.columns)} from ({fa.ORACLE})").fetchall()) == rows(got)


def test_empty_tables_and_clashing_columns(spark, table):
    docs, labels = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"
    assert fa.op12_filter_audit(table([], docs), table([], labels)).count() == 0
    d = table([(1, "a", "en")], docs)
    for name in ("part", "mask", "digest", "rows", "quality", "toxic", "first", "n", "a.b"):
        d = d.withColumn(name, F.lit("x"))
    assert rows(fa.op12_filter_audit(d, table([], labels))) == sorted(fa.brute_force([(1, "a", "en")], []))


def test_swaps_lead_through_all_orders():
    for n in (1, 2, 3, 5):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in fa.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_a_swapped_diagram_is_the_one_built_in_that_order():
    r = random.Random(8)
    weights = {m: (r.randint(0, 3), 0, 0) for m in range(32)}
    diagram = fa.Diagram("ABCDE", weights)
    for k in fa.swaps(5):
        diagram.swap(k)
        bit = {x: "ABCDE".index(x) for x in "ABCDE"}
        turned = {sum((m >> bit[x] & 1) << at for at, x in enumerate(diagram.order)): w for m, w in weights.items()}
        fresh = fa.Diagram("".join(diagram.order), turned)
        assert diagram.all_pass() == fresh.all_pass() and [diagram.only(x) for x in "ABCDE"] == [fresh.only(x) for x in "ABCDE"]


def test_equal_nodes_are_one():
    diagram = fa.Diagram("ABCDE", {0: (1, 0, 0)})
    assert len(diagram.nodes) == 2 + 5 + 4  # two leaves, a path, nodes without weight at four levels
