"""The audit as one flow, rule files, parameters, red shares, crops and labels."""

import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rules import LINE, SCHEMA

from folioscope import cli
from folioscope.operators import audit, classify, image, page_rules, segment
from folioscope.plans import catalog as c
from folioscope.plans import page_queries
from folioscope.sources import labels, rulefiles, tables
from folioscope.streaming import archives

CATALOG = """
meta: {name: base}
rules_a:
  A01_date_format: {enabled: true, level: HIGH, title: dates, clause: eight digits, params: {skip_if_contains: [], exclude_forms: [甲]}}
  A10_decimal_precision: {level: medium, params: {max_decimals: 2, require_keywords: []}}
  Z01_unknown: {enabled: true}
rules_b: {B01_seal_tilt: {enabled: "off"}}
"""
PACK = """
meta: {name: one}
forms: {patterns: [{form: 乙, keywords: [乙单]}], internal: [乙], structural: [{all: [型号, 批次], form: 丙}]}
rules_f: {F07_reject_note: {enabled: true, params: {applies_to: [乙]}}}
overrides: {B01_seal_tilt: {enabled: true, params: {max_tilt_deg: 40}}, A01_date_format: {level: low}}
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "packs").mkdir()
    (tmp_path / "rules.yaml").write_text(CATALOG)
    (tmp_path / "packs" / "one.yaml").write_text(PACK)
    return tmp_path


def page(lines, cells=(), seals=(), segments=(), doc="D", no=1, pages=1, form="质量证明单", red=0.0):
    placed = [(i, *(x if isinstance(x, tuple) else (x, 100, 100 + 40 * i, 300, 30))) for i, x in enumerate(lines)]
    number = lambda xs: [(i, *x) for i, x in enumerate(xs)]
    return (doc, no, pages, form, 1000, 1400, red, 0.0, placed, number(cells), number(seals), number(segments))


def test_rule_files(files):
    pytest.importorskip("yaml")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        book, forms, metas = rulefiles.load(str(files / "rules.yaml"))
    assert any("Z01" in str(w.message) for w in said) and [m["name"] for m in metas] == ["one"]
    assert book["A01"].level == "LOW" and book["A01"].clause == "eight digits" and book["A01"].exclude == ("甲",) and book["A10"].level == "MEDIUM"
    assert book["B01"].enabled and book["B01"].params["max_tilt_deg"] == 40 and book["F07"].include == ("乙",) and "A02" not in book
    assert forms.known()[:2] == ["供方合格证", "乙"] and "丙" in forms.known() and forms.internal == {"乙", "检验记录"}
    bare, plain, _ = rulefiles.load(str(files / "rules.yaml"), None)
    assert not bare["B01"].enabled and plain == classify.DEFAULT
    assert rulefiles.fingerprint(str(files / "rules.yaml")) != rulefiles.fingerprint(str(files / "rules.yaml"), None)
    (files / "packs" / "two.yaml").write_text(PACK)
    with pytest.raises(ValueError, match="two packs"):
        rulefiles.load(str(files / "rules.yaml"))
    (files / "packs" / "two.yaml").write_text(PACK.replace("name: one", "name: two"))
    with pytest.raises(ValueError, match="again"):
        rulefiles.load(str(files / "rules.yaml"))
    (files / "packs" / "two.yaml").write_text("overrides: {A77_none: {level: LOW}}")
    with pytest.raises(ValueError, match="A77"):
        rulefiles.load(str(files / "rules.yaml"))


def test_forms_read_joined_lines_and_suppliers_first(spark):
    forms = classify.DEFAULT.merged(classify.Forms((("质量证明单", ("证明单", "质量证明书")),)))
    rows = [([(0, "产品质量", 0, 10, 9, 9), (1, "证明书", 0, 30, 9, 9)],), ([(0, "检验", 0, 900, 9, 9), (1, "记录", 0, 930, 9, 9)],), ([(0, "规定", 0, 900, 9, 9), (1, "实际", 0, 930, 9, 9), (2, "检验员", 0, 950, 9, 9)],), ([],)]
    df = spark.createDataFrame(rows, f"lines {LINE}").withColumn("height", F.lit(1000))
    assert [r.f for r in df.select(F.expr(forms.sql()).alias("f")).collect()] == ["供方合格证", "检验记录", "检验记录", "未识别"]
    assert spark.range(1).select(F.expr(classify.DEFAULT.is_internal("'检验记录'")), F.expr(classify.Forms(()).is_internal("'x'"))).first()[:] == (True, False)


@pytest.mark.parametrize(
    ("rule", "params", "row", "before", "after"),
    [
        ("B01", {"max_tilt_deg": 89}, page(["a", "b", "c"], seals=[(100, 100, 90, 90, 30.0, 8100, 0.5, 0.9)]), 1, 0),
        ("A09", {"strict_order": True}, page(["共4页 第1页", "a", "b"], pages=4), 0, 1),
        ("A09", {"flag_missing": True}, page(["x", "a", "b"], pages=4), 0, 1),
        ("A09", {"min_pages": 9}, page(["第1页", "a", "b"], pages=4), 1, 0),
        ("A10", {"max_decimals": 5}, page(["称重 1.23456"]), 1, 0),
        ("A10", {"require_keywords": []}, page(["1.23456"]), 0, 1),
        ("A18", {"flag_missing_field": True}, page(["此件与原件一致"]), 0, 1),
        ("B04", {"check_all_fields": True}, page(["a"], cells=[("任意栏", 0, 0, 100, 50, 0.0), ("", 100, 0, 100, 50, 0.0)]), 0, 1),
        ("A01", {"skip_if_contains": []}, page(["2023-1-1年月日"]), 0, 1),
        ("A03", {"forbidden": ["x"]}, page(["φ48"]), 1, 0),
        ("A13", {"required_text": "与原件相符"}, page(["与原件相符"]), 1, 0),
        ("B06", {"max_per_page": 9}, page([("abc", 100, 100, 200, 30)], segments=[(100, 112, 200, 3)] * 4), 1, 0),
        ("F06", {"required_fields": ["批次"]}, page(["批次 1", "a", "b"], form="检验记录"), 1, 0),
    ],
)
def test_parameters_reach_the_rules(spark, rule, params, row, before, after):
    df = spark.createDataFrame([row], SCHEMA)
    for book, n in ((c.BOOK, before), (c.with_packs(c.BOOK, {rule: {"params": params}}), after), (c.with_overrides(c.BOOK, {rule: {"params": json.dumps(params)}}), after)):
        assert page_rules.findings(df, rule, book=book).count() == n


def test_a_rule_that_does_not_fit_leaves_the_others(spark):
    df = spark.createDataFrame([page(["2023.6.1", "重量三十公斤"])], SCHEMA)
    book = c.with_packs(c.BOOK, {"A10": {"params": {"max_decimals": "many"}}, "A03": {"params": {"forbidden": 7}}})
    with pytest.warns(UserWarning, match="A10|A03"):
        assert {"A01", "A08"} <= {r.rule_id for r in page_rules.findings(df, book=book).collect()}
    odd = df.withColumn("segments", F.array(F.lit(1)))
    with pytest.warns(UserWarning, match="B06"):
        assert {"A01", "A08"} <= {r.rule_id for r in page_rules.findings(odd).collect()}


def test_red_dates_and_red_regions(spark):
    seal = [(100, 100, 300, 30, 0.0, 9000, 0.5, 0.9)]
    df = spark.createDataFrame([page(["2023.06.01", "a", "b"], seals=seal)], SCHEMA)
    assert page_rules.findings(df, "B03").count() == 1
    red = lambda x: df.withColumn("lines", F.expr(f"transform(lines, l -> named_struct('line_no', l.line_no, 'text', l.text, 'x', l.x, 'y', l.y, 'w', l.w, 'h', l.h, 'red_ratio', {x}))"))
    assert page_rules.findings(red("0.03D"), "B03").count() == 0 and page_rules.findings(red("0.02D"), "B03").count() == 1
    table = [("检验员", 600, 300, 90, 30), ("1", 100, 400, 90, 30), ("2", 100, 500, 90, 30)]
    df = spark.createDataFrame([page(table, red=0.01)], SCHEMA)  # a stamp somewhere else
    assert page_rules.findings(df, "B07").count() == 0
    shares = lambda a, b: page_rules.findings(df.withColumn("column_red", F.lit(a)).withColumn("row_red", F.lit(b)), "B07").count()
    assert (shares(0.0, 0.0), shares(0.003, 0.0), shares(0.0, 0.003)) == (1, 0, 0)


def test_red_shares_from_images(spark):
    img = np.full((1400, 1000, 3), 255, np.uint8)
    img[300:330, 100:400] = (10, 40, 220)  # a red line of text
    img[800:900, 620:680] = (10, 40, 220)  # a stamp below the header
    data = bytearray(img.tobytes())
    images = spark.createDataFrame([("p1", 1400, 1000, 3, data)], "origin string, height int, width int, nChannels int, data binary")
    row = page([("检验员", 600, 300, 90, 30), ("2023.06.01", 100, 300, 300, 30), ("x", 100, 600, 90, 30)])
    out = image.with_red(spark.createDataFrame([row], SCHEMA).withColumn("origin", F.lit("p1")), images).first()
    assert [round(x.red_ratio, 2) for x in out.lines] == [0.0, 1.0, 0.0] and out.column_red > 0.02 and out.row_red == 0.0


def test_turned_pages_become_straight_and_cells_know_their_ink():
    img = np.full((500, 700, 3), 255, np.uint8)
    for y in range(60, 440, 60):
        img[y : y + 3, 40:660] = 0
    turned, angle = image.straight(img, 3.0)
    assert angle == 3.0 and abs(image.skew(turned)) > 2 and image.straight(img, 0.1)[1] == 0.0
    again, _ = image.straight(turned)
    assert abs(image.skew(again)) <= 0.4
    cell = np.full((60, 80, 3), 230, np.uint8)
    assert image.cell_ink(cell, 0, 0, 80, 60) == 0 and image.cell_ink(cell, 0, 0, 6, 6) == 1
    cell[20:40, 20:40] = 30
    assert 0.08 < image.cell_ink(cell, 0, 0, 80, 60) < 0.12
    assert np.allclose(image.resized(np.full((3, 4), 7.0), 9, 10), 7) and image.resized(np.eye(4), 8, 8).max() > 0.9


def test_audit_finds_pages_and_units_once(spark, tmp_path):
    same = ["2023.6.1", ("2023.6.1", 100, 100, 300, 30), "零件号 A-1", "文字" * 40]
    rows = [page([*same, f"第{i}页共3页"], cells=[("零件号", 0, 600, 80, 40, 0.1), ("A-1", 90, 600, 80, 40, 0.1)], doc="D", no=i, pages=2) for i in (1, 2)]
    pages = spark.createDataFrame(rows, SCHEMA)
    found, units = audit.audit(pages)
    got = found.collect()
    dates = [r for r in got if r.rule_id == "A01"]
    assert len(dates) == 2 and {r.page_no for r in dates} == {1, 2} and tuple(dates[0].box) == (100, 100, 300, 30)  # two equal lines in one place are one
    assert [(r.page_count, r.declared_total, r.form_type) for r in units.collect()] == [(2, 3, "质量证明单")]
    (missing,) = [r for r in got if r.rule_id == "U01"]
    assert missing.unit_id == "D#U001" and missing.level == "CRITICAL" and missing.message.endswith(": 1") and missing.box is None
    told = {(r.kind, r.doc_id, r.rule_id): (r.findings, r.spread) for r in audit.report(found, pages).collect()}
    assert told["single", "D", "A01"] == (2, 2) and not any(k == "batch" for k, _, _ in told)
    switched = c.with_packs(c.BOOK, {"A01": {"enabled": False}, "U01": {"enabled": False}})
    assert not {"A01", "U01"} & {r.rule_id for r in audit.audit(pages, book=switched)[0].collect()}
    empty = audit.audit(pages.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0
    pages.write.parquet(f"{tmp_path}/pages")
    cli.main(["audit", f"{tmp_path}/pages", f"{tmp_path}/out", "--units", f"{tmp_path}/units"], spark)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got) and spark.read.parquet(f"{tmp_path}/units").count() == 1


def test_unit_rules_take_their_parameters(spark):
    rows = [page([f"第{i}页共9页", "字" * 50], doc="D", no=i - 1, pages=2) for i in (2, 3)]
    told = audit.digests(spark.createDataFrame(rows, SCHEMA))
    u = segment.units(segment.page_units(told))
    ids = lambda changes: sorted({r.rule_id for r in segment.findings(u, c.with_packs(c.BOOK, changes)).collect()})
    assert ids({}) == [] and ids({"U01": {"params": {"flag_missing_head": True}}}) == ["U01"]
    same = [page(["同" * 70], doc="D", no=i, pages=2) for i in (1, 2)]
    told = audit.digests(spark.createDataFrame(same, SCHEMA))
    u = segment.units(segment.page_units(told))
    assert ids({}) == ["U03", "U04"] or ids({}) == ["U04"]
    assert "U04" not in ids({"U04": {"params": {"min_text_len": 71}}})
    key = lambda df: sorted((r.unit_id, r.page_no, r.detail) for r in df.collect())
    assert key(segment.repeated_records(u)) == key(segment.repeated_records(u.drop("prints"), told)) != []


def test_audit_from_a_catalog_file(spark, files, tmp_path):
    pytest.importorskip("yaml")
    spark.createDataFrame([page(["乙单", "2023.6.1", "1.234"], form="x")], SCHEMA).write.parquet(f"{tmp_path}/pages")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cli.main(["audit", f"{tmp_path}/pages", f"{tmp_path}/out", "--catalog", str(files / "rules.yaml")], spark)
    got = {(r.rule_id, r.level, r.title) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("A01", "LOW", "dates"), ("A10", "MEDIUM", "A10_decimal_precision")}


def test_boxes_of_groups(spark):
    seals = [(100, 100, 100, 100, 0.0, 10000, 0.5, 0.9), (110, 110, 120, 80, 0.0, 9600, 0.5, 0.9)]
    cells = [("零件号", 0, 0, 100, 50, 0.0), *[("", 0, 60 * i, 100, 50, 0.0) for i in (1, 2, 3)]]
    got = {r.rule_id: r.box and tuple(r.box) for r in audit.page_findings(spark.createDataFrame([page(["a", "b", "c"], cells, seals)], SCHEMA), "B02", "B04").collect()}
    assert got["B02"] == (100, 100, 130, 100)
    strokes = [(100, 112, 200, 3)] * 3 + [(110, 108, 190, 4)]
    (b06,) = audit.page_findings(spark.createDataFrame([page([("abc", 100, 100, 200, 30)], segments=strokes)], SCHEMA), "B06").collect()
    assert tuple(b06.box) == (100, 108, 200, 7)


def test_streamed_archives_close_as_in_the_batch(spark):
    import pandas as pd

    d = page_queries.derived.pages(spark, "/root/testdata/sf0.001", "lines", "cells").where("doc_id < '14'")
    told = audit.digests(d)
    want = {(r.doc_id, r.unit_no): r.n for r in segment.page_units(told).groupBy("doc_id", "unit_no").count().withColumnRenamed("count", "n").collect()}
    got = {}
    for doc, rows in archives._paged(told).toPandas().groupby("doc_id"):
        out = archives._closed((doc,), [json.loads(x) for x in rows.page])
        assert isinstance(out, pd.DataFrame)
        got |= {(doc, u): n for u, n in zip(out.unit_no, out.page_count, strict=True)}
    assert got == want


def test_crops_labels_and_models(spark, tmp_path):
    img = np.full((200, 300, 3), 255, np.uint8)
    img[50:110, 60:140] = (10, 40, 220)
    images = spark.createDataFrame([("p", 200, 300, 3, bytearray(img.tobytes())), ("q", 9, 9, 3, bytearray(b"x"))], "origin string, height int, width int, nChannels int, data binary")
    measured = image.measured(images).withColumn("doc_id", F.lit("档 1")).withColumn("page_no", F.lit(1))
    crops = labels.seal_crops(images, measured)
    (one,) = crops.collect()
    assert one.id == "__1_p0001_00" or one.id.endswith("_p0001_00") and len(one.data) == one.height * one.width * 3
    assert labels.unwritten(crops, crops.limit(0)).count() == 1 and labels.unwritten(crops, crops).count() == 0
    many = spark.range(650).withColumn("doc_id", F.lit("d"))
    assert sorted(r["count"] for r in labels.sheets(many, "id").groupBy("sheet").count().collect()) == [50, 300, 300]
    (tmp_path / "labels_1.json").write_text(json.dumps({"labels": {"a": "ok", "b": "faint"}}))
    (tmp_path / "labels_2.json").write_text(json.dumps({"b": "chipped", "z": "skip"}))
    merged = labels.read_labels(spark, [f"{tmp_path}/labels_2.json", f"{tmp_path}/labels_1.json"])
    assert {(r.id, r.label) for r in merged.collect()} == {("a", "ok"), ("b", "chipped"), ("z", "skip")}
    (tmp_path / "manifest.json").write_text(json.dumps([{"id": x, "file": f"seals/{x}.jpg", "doc_id": "d", "page_no": 1} for x in "abz"]))
    (tmp_path / "synth.json").write_text(json.dumps([{"file": "seals/a.jpg", "label": "ok", "source": "a", "synthetic": False}, {"file": "s.jpg", "label": "faint", "source": "a", "synthetic": True}]))
    rows = labels.training_rows(labels.read_manifest(spark, f"{tmp_path}/manifest.json"), merged, labels.read_synthetic(spark, f"{tmp_path}/synth.json"))
    assert {(r.file, r.label, r.synthetic, r.human) for r in rows.collect()} == {("seals/a.jpg", "ok", False, True), ("seals/b.jpg", "chipped", False, True), ("s.jpg", "faint", True, False)}
    labels.write_linear(spark, f"{tmp_path}/model", mean=[0, 0], scale=[1, 2], coef=[[1, 0], [0, 1]], intercept=[0, 0], classes=["x", "y"])
    df = spark.createDataFrame([(1, [3.0, 2.0]), (2, [0.0, 8.0])], "i int, f array<double>")
    out = {r.i: (r.label, r.p) for r in labels.linear_predictions(df, spark.read.parquet(f"{tmp_path}/model"), F.col("f")).collect()}
    assert out[1][0] == "x" and out[2][0] == "y" and out[1][1] == pytest.approx(1 / (1 + np.exp(-2)))


def test_pages_of_gold_sets_and_one_page(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"findings": [], "reviewed_pages": [["d", "1"], ["d", "2"], ["d", "2"]]}))
    assert {tuple(r) for r in tables.read_reviewed_pages(spark, f"{tmp_path}/gold.json").collect()} == {("d", 1), ("d", 2)}
    scans = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc_id string, page_no int, source string")
    assert [r.source for r in tables.page_at(scans, "d", 2).collect()] == ["b"]
    (tmp_path / "findings.json").write_text(json.dumps({"findings": [{"doc_id": "d", "page_no": 1, "rule_id": "A01", "confidence": 0.5}]}))
    assert labels.read_predictions(spark, f"{tmp_path}/findings.json").first().rule_id == "A01"




def test_odd_pages_lose_nothing_but_what_is_odd(spark):
    sound = [page(["2023.6.1", "重量三十公斤", "a"], no=i) for i in range(7)]
    df = spark.createDataFrame(sound, SCHEMA)
    lines = lambda text="l.text", x="l.x", w="l.w": f"transform(lines, l -> named_struct('line_no', l.line_no, 'text', {text}, 'x', {x}, 'y', l.y, 'w', {w}, 'h', l.h))"
    odd = [
        lines(text="if(l.line_no = 2, NULL, l.text)"),
        f"concat(array(NULL), {lines()})",
        lines(x="CAST(NULL AS INT)"),
        lines(x="2147483647", w="2147483647"),
    ]
    cases = {i: F.expr(sql) for i, sql in enumerate(odd)}
    column = F.col("lines")
    for i, sql in cases.items():
        column = F.when(F.col("page_no") == i, sql).otherwise(column)
    df = df.withColumn("lines", column).withColumn("form_type", F.when(F.col("page_no") == 4, None).otherwise(F.col("form_type")))
    df = df.withColumn("height", F.when(F.col("page_no") == 5, 0).otherwise(F.col("height"))).withColumn("seals", F.when(F.col("page_no") != 6, F.col("seals")))
    got = {}
    for r in page_rules.findings(df, "A01", "A08", "B01", "B05").collect():
        got.setdefault(r.page_no, set()).add((r.rule_id, r.detail == page_rules.FAILED))
    assert all({("A01", False), ("A08", False)} <= got[i] for i in range(7))
    assert {i: {r for r, failed in x if failed} for i, x in got.items()} == {0: set(), 1: set(), 2: set(), 3: set(), 4: set(), 5: {"B05"}, 6: {"B01"}}
    found, units = audit.audit(df.withColumn("doc_id", F.lit("D")))
    low = [(r.page_no, r.rule_id, r.level, r.title, r.confidence) for r in found.collect() if r.title == "rule failed"]
    assert low and all(x[2] == "LOW" and x[4] == 0.0 for x in low) and (6, "B01", "LOW", "rule failed", 0.0) in low
    assert sum(r.page_count for r in units.collect()) == 7


def test_pages_without_lines_are_units_all_the_same(spark):
    df = spark.createDataFrame([page(["a"], no=1), page(["b"], no=2)], SCHEMA).withColumn("lines", F.expr("if(page_no = 2, NULL, lines)"))
    assert [r.page_no for r in audit.digests(df).orderBy("page_no").collect()] == [1, 2]


def test_missing_pages_are_ranges(spark):
    row = lambda doc, *numbers: (doc, f"{doc}#U001", "检验记录", [*range(1, len(numbers) + 1)], len(numbers), 1, None, [(i, n, n) for i, n in enumerate(numbers, 1)])
    df = spark.createDataFrame([row("far", 1, 2, 90_000_000), row("two", 1, 3, 7), row("most", 1, 2**31 - 1), row("same", 5, 5, 9), row("fine", 4, 5, 6), row("one", 9)], "doc_id string, unit_id string, form_type string, pages array<int>, page_count int, start_page int, declared_total int, markers array<struct<page_no:int,current:int,total:int>>")
    df = df.withColumn("first_marker", F.expr("markers[0]"))
    got = {r.doc_id: r.detail for r in segment.page_sequence(df).collect()}
    assert got == {"far": "lacks 3-89999999", "two": "lacks 2,4-6", "most": f"lacks 2-{2**31 - 2}", "same": "repeats 5"}
