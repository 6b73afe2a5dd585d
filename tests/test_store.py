"""Segmentation, collapsing, verdicts, gold sets, stored runs, sources."""

import json

from pyspark.sql import functions as F

from folioscope.operators import findings as f
from folioscope.operators import segment, store
from folioscope.plans import registry
from folioscope.sources import derived, tables

DIGEST = "doc_id string, page_no int, form_type string, keys map<string,string>, marker struct<current:int,total:int>, has_title boolean, text_len int, fingerprint string"


def digest(n, form="表", keys=None, marker=None, title=False, fp="", doc="D"):
    return (doc, n, form, keys or {}, marker, title, 200, fp)


def cut(spark, pages):
    df = spark.createDataFrame(pages, DIGEST).repartition(3)
    paged = segment.page_units(df)
    loop = {(r.doc_id, r.page_no): r.unit_no for r in segment.segment_long(df).collect()}
    assert {(r.doc_id, r.page_no): r.unit_no for r in paged.collect()} == loop
    return paged, {r.unit_id: r for r in segment.units(paged).collect()}


def test_unit_numbers_above_999_are_not_cut(spark):
    df = spark.createDataFrame([digest(i, marker=(1, 1)) for i in range(1, 1003)], DIGEST)
    ids = [r.unit_id for r in segment.units(segment.page_units(df)).orderBy("unit_no").collect()]
    assert ids == [f"D#U{i:03d}" for i in range(1, 1003)]


def test_units_of_a_run_are_listed_for_all_documents(spark):
    u = segment.units(segment.page_units(spark.createDataFrame([digest(n, keys={"k": str(n)}, doc=d) for d in ("8", "7", "12") for n in (1, 2)], DIGEST)))
    assert [(r.doc_id, r.start_page) for r in segment.listed(u).collect()] == [(d, n) for d in ("12", "7", "8") for n in (1, 2)]
    assert [r.unit_id for r in segment.listed(u, "8").collect()] == ["8#U001", "8#U002"]


def test_html_is_escaped_to_its_end(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 400 + "<a b=\"c\">&'"), (2, None)], "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    shown = {r.page_id: r.shown for r in registry.queries()["fn_escape_whole"](spark, str(tmp_path)).collect()}
    assert shown == {1: "x" * 400 + "&lt;a b=&quot;c&quot;&gt;&amp;&#x27;", 2: None}


def test_ledger_numbers_a_whole_run(spark):
    rows = [(doc, page, level, f"{doc}|{page}|{level}", "m") for doc in ("1", "10", "2") for page in (1, 2, 10) for level in ("LOW", "CRITICAL", "ODD", "HIGH")]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, level string, finding_key string, message string").repartition(5)
    rank = {"CRITICAL": 0, "HIGH": 1}
    want = [r[3] for r in sorted(rows, key=lambda r: (rank.get(r[2], 3), r[0], r[1], r[3]))]
    got = f.ledger(df)
    assert [(r.no, r.finding_key) for r in got.orderBy("no").collect()] == list(enumerate(want, 1))
    assert got.schema["no"].dataType.simpleString() == "int"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_archive_overview_has_one_sided_documents(spark):
    pages = spark.createDataFrame([("both", 1), ("both", 2), ("pages", 1)], "doc_id string, page_no int")
    units = spark.createDataFrame([("both", "both#U001"), ("pages", "pages#U001")], "doc_id string, unit_id string")
    rows = spark.createDataFrame([("both", "LOW"), ("both", "ODD"), ("found", "CRITICAL")], "doc_id string, level string")
    got = {r.doc_id: tuple(r)[1:] for r in f.archive_overview(pages, units, rows).collect()}
    assert got == {"both": (2, 1, 2, 0, 0, 0, 1), "pages": (1, 1, 0, 0, 0, 0, 0), "found": (0, 0, 1, 1, 0, 0, 0)}


def test_units(spark):
    pages = lambda us: sorted(u.pages for u in us.values())
    assert pages(cut(spark, [digest(1, keys={"k": "1"}), digest(2, keys={"k": "1"}), digest(3, keys={"k": "2"})])[1]) == [[1, 2], [3]]
    _, us = cut(spark, [digest(i, marker=(i, 3)) for i in (1, 2, 3)])
    assert pages(us) == [[1, 2, 3]] and us["D#U001"].declared_total == 3
    assert pages(cut(spark, [digest(1, marker=(1, 2)), digest(2, marker=(2, 2)), digest(3, marker=(1, 2))])[1]) == [[1, 2], [3]]
    assert cut(spark, [digest(1, marker=(13, 19)), digest(2, marker=(14, 19))])[1]["D#U001"].declared_total is None
    mixed = [digest(1, keys={"k": "A"}), digest(2, keys={"k": "B"}), digest(3, keys={"k": "A"})]
    us = cut(spark, mixed)[1]
    assert sorted(us) == ["D#U001", "D#U002"] and us["D#U001"].pages == [1, 3]
    assert pages(cut(spark, [digest(1, "甲"), digest(2, "乙"), digest(3, "甲")])[1]) == [[1], [2], [3]]
    assert pages(cut(spark, [digest(1, "甲"), digest(2, "未识别"), digest(3, "甲")])[1]) == [[1, 2, 3]]


def test_unit_rules(spark):
    pages = [digest(1, marker=(1, 4)), digest(2, marker=(2, 4)), digest(3, marker=(2, 4)), digest(4, keys={"k": "x"}, title=True, fp="aa", marker=(1, 9)), digest(5, fp="bb"), digest(6, fp="aa")]
    df = spark.createDataFrame(pages, DIGEST)
    us = segment.units(segment.page_units(df))
    by = lambda x: [(r.unit_id, r.page_no, r.detail) for r in x.collect()]
    assert by(segment.missing_pages(us)) == [("D#U001", 1, "1"), ("D#U002", 4, "6")] or len(by(segment.missing_pages(us))) == 2
    assert by(segment.page_sequence(us)) == [("D#U001", 1, "repeats 2")]
    assert by(segment.unnumbered_pages(us)) == [("D#U002", 5, "2: 5,6")]
    assert by(segment.repeated_records(us, df)) == [("D#U002", 4, "4,6")]


FINDING = "run_id string, doc_id string, page_no int, rule_id string, level string, message string, seq int"


def test_keys_dedupe_and_order(spark):
    rows = [("r", "d", 1, "A01", "HIGH", "m", 2), ("r", "d", 1, "A01", "HIGH", "m", 1), ("r", "d", 1, "A01", "LOW", "n", 3)]
    df = spark.createDataFrame(rows, FINDING)
    assert {(r.seq, r.finding_key) for r in f.with_key(df).collect()} == {(1, "r|d|1|A01|1"), (2, "r|d|1|A01|2"), (3, "r|d|1|A01|3")}
    assert sorted(r.seq for r in f.deduplicated(df, "rule_id", "doc_id", "page_no", "message").collect()) == [1, 3]
    assert [r.seq for r in f.by_severity(df).collect()] == [1, 2, 3]


def test_collapse(spark):
    rows = [("r", "d", i % 4, "A01", "HIGH", f"m{i}", i) for i in range(6)] + [("r", f"e{i % 7}", i, "A02", "LOW", "m", 100 + i) for i in range(30)] + [("r", "z", 1, "A03", "LOW", "m", 500)]
    pages = spark.createDataFrame([("d", i) for i in range(5)] + [(f"e{k}", i) for k in range(7) for i in range(99)] + [("z", 1)], "doc_id string, page_no int")
    systemic, batch, left = f.collapse(spark.createDataFrame(rows, FINDING).repartition(4), pages)
    assert [(r.doc_id, r.findings, r.hit_pages, r.message, r.preview) for r in systemic.collect()] == [("d", 6, 4, "m0", "0,1,2,3")]
    assert [(r.rule_id, r.findings, r.documents, r.top_docs) for r in batch.collect()] == [("A02", 30, 7, "e0:5,e1:5,e2:4,e3:4,e4:4")]
    assert [r.seq for r in left.collect()] == [500]


def test_evaluation_and_gold(spark):
    key = "doc_id string, page_no int, rule_id string"
    said = spark.createDataFrame([("d", 1, "A"), ("d", 1, "A"), ("d", 2, "B"), ("d", 3, "C")], key)
    gold = spark.createDataFrame([("d", 1, "A", "positive"), ("d", 2, "B", "negative")], key + ", kind string")
    assert tuple(f.evaluation(said, gold).first()) == (1, 1, 0, 1, 1.0, 0.5)
    verdicts = [("d", 1, "A", "true", "1", "k1"), ("d", 1, "A", "false", "2", "k2"), ("d", 1, "A", "unsure", "3", "k3"), ("d", 2, "B", "unsure", "1", "k4"), ("d", 2, "B", "true", "2", "k5"), ("d", 3, "C", "unsure", "1", "k6")]
    merged = f.merged_gold(spark.createDataFrame(verdicts, key + ", verdict string, decided_at string, finding_key string"))
    assert {(r.rule_id, r.kind, r.unsure) for r in merged.collect()} == {("A", "negative", True), ("B", "positive", False), ("C", None, True)}


def test_runs_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "finding")
    store.import_run(spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int"), path)
    store.import_run(spark.createDataFrame([("r1", 9)], "run_id string, v int"), path)
    assert {(r.run_id, r.v) for r in spark.read.parquet(path).collect()} == {("r1", 9), ("r2", 2)}


def test_upserts_and_verdicts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in store.upserted(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    verdicts = spark.createDataFrame([("x", "true", "u", "1"), ("y", "true", "u", "1")], "finding_key string, verdict string, reviewer string, decided_at string")
    changes = spark.createDataFrame([("x", "false", "v", "2", 1), ("x", "", "v", "3", 2), ("z", "unsure", "v", "2", 1)], "finding_key string, verdict string, reviewer string, decided_at string, seq int")
    assert {(r.finding_key, r.verdict) for r in store.judged(verdicts, changes).collect()} == {("y", "true"), ("z", "unsure")}


def test_page_scan_counts_broken_files(spark, tmp_path):
    for name in ("a/1.png", "a/2.TIF", "a/b/x.jpg", "a/b/y.txt", "c/b/z.bmp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"no image")
    pages = tables.scan_pages(spark, str(tmp_path))
    assert {(r.doc_id, r.page_no, r.source.rsplit("/", 1)[1]) for r in pages.collect()} == {("a", 1, "1.png"), ("a", 2, "2.TIF"), ("b", 1, "x.jpg"), ("b", 1, "z.bmp")}
    assert {tuple(r) for r in tables.page_counts(pages).collect()} == {("a", 2), ("b", 2)}


def test_gold_and_review_files(spark, tmp_path):
    one = {"doc_id": "d", "page_no": 1, "rule_id": "A"}
    (tmp_path / "gold.json").write_text(json.dumps({"findings": [one], "false_positives": [one | {"page_no": 2}], "unsure": [], "reviewed_pages": [["d", "1"]]}, indent=1))
    assert {(r.kind, r.page_no) for r in tables.read_gold(spark, str(tmp_path / "gold.json")).collect()} == {("positive", 1), ("negative", 2)}
    (tmp_path / "r.json").write_text(json.dumps({"reviewer": "u", "adjudications": [one | {"verdict": "true", "note": "n"}]}))
    assert tables.read_reviews(spark, [str(tmp_path / "r.json")] * 2).count() == 2
    (tmp_path / "log.txt").write_text("\n".join(map(str, range(10))))
    assert [r.value for r in tables.log_tail(spark, str(tmp_path / "log.txt"), 3).collect()] == ["7", "8", "9"]


def test_nested_rows_equal_the_derived_ones(spark):
    sf = "/root/testdata/sf0.001"
    whole = derived.pages(spark, sf, "lines", "cells").where("doc_id < '2'")
    bare = whole.drop("lines", "cells")
    flat = {p: whole.select("doc_id", "page_no", F.explode(p).alias("e")).select("doc_id", "page_no", "e.*") for p in ("lines", "cells")}
    again = derived.nested(bare, **flat)
    assert again.select("doc_id", "page_no", "lines", "cells").exceptAll(whole.select("doc_id", "page_no", "lines", "cells")).count() == 0 and again.count() == whole.count()
