"""Running values, row numbers and top rows against windows over whole groups; archives cut at pages 1."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import findings, ranges, segment

DIGEST = "doc_id string, page_no int, form_type string, keys map<string,string>, marker struct<current:int,total:int>, has_title boolean, text_len int, fingerprint string"


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_running_values_are_those_of_a_window(spark):
    r = random.Random(1)
    rows = [(k, at, r.choice([None, 1, 5, -2])) for k in ("a", "b", None) for at in r.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    for how, fold in (("sum", F.sum), ("max", F.max)):
        for own in (True, False):
            w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
            same(ranges.running(df, "k", "at", F.col("v"), "x", how=how, own=own, width=16).select("k", "at", "v", "x"), df.withColumn("x", fold("v").over(w)))


def test_row_numbers_and_top_rows_are_those_of_a_window(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), r.choice([None, *map(str, range(40))]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, d string, i int").repartition(7)
    same(ranges.row_numbers(df, "k", F.col("d").desc(), "i").select("no", "k", "d", "i"), df.select(F.row_number().over(Window.orderBy("k", F.col("d").desc(), "i")).alias("no"), "*"))
    order = [F.desc("d"), F.asc("i")]
    same(ranges.top(df, "k", 7, *order, spread="i", parts=16).select("k", "d", "i", "at"), df.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where("at <= 7"))
    assert ranges.row_numbers(df.where("false"), "k").count() == 0


def digests(spark, seed, archives, pages):
    r, rows = random.Random(seed), []
    for a in range(archives):
        for no in range(1, pages + 1):
            marker = r.choice([None, None, (r.randint(1, 4), r.choice([3, 4]))])
            rows.append((f"D{a}", no, r.choice(["甲", "乙", "未识别"]), {x: r.choice("12") for x in ("批次号", "图号") if r.random() < 0.3}, marker, r.random() < 0.2, 50, r.choice(["", "f1", "f2"])))
    return spark.createDataFrame(rows, DIGEST).repartition(6)


def test_archives_cut_at_pages_1_have_the_same_units(spark, monkeypatch):
    monkeypatch.setattr(ranges, "WIDTH", 8)
    d = digests(spark, 3, 12, 90).cache()
    whole = segment.page_units(d).select("doc_id", "page_no", "unit_no")
    cut = segment.page_units(d, split=True)
    same(cut.select("doc_id", "page_no", "unit_no"), whole)
    same(segment.segment_long(d), whole)
    assert set(cut.columns) == {*d.columns, "unit_no"}
    pick = ("unit_id", "pages", "declared_total", "keys")
    same(segment.units(cut).select(*pick), segment.units(segment.page_units(d)).select(*pick))
    assert segment.stretches(d).select("doc_id", "stretch").distinct().count() > 100


def test_one_long_archive_is_many_tasks(spark):
    n = 200_000
    d = spark.range(1, n + 1).selectExpr("'D' AS doc_id", "CAST(id AS INT) AS page_no", "'甲' AS form_type", "CAST(map() AS map<string,string>) AS keys", "named_struct('current', CAST((id - 1) % 5 + 1 AS INT), 'total', 5) AS marker", "false AS has_title", "50 AS text_len", "'' AS fingerprint")
    out = segment.page_units(d, split=True)
    assert out.groupBy((F.col("page_no") - 1 - (F.col("unit_no") - 1) * 5).between(0, 4)).count().collect() == [(True, n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small pieces would be put together again
    try:
        assert segment.stretches(d).groupBy("doc_id", "stretch").agg(F.count("*")).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_window_over_few_groups(spark):
    f = spark.createDataFrame([("k", "D", 1, "A01", "HIGH", "m", 1)], "finding_key string, doc_id string, page_no int, rule_id string, level string, message string, seq int")
    assert "Window" not in findings.numbered(f)._jdf.queryExecution().optimizedPlan().toString()
