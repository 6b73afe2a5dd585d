"""Image kernels on drawn pages, sinks read back, streams run to their end."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import image
from folioscope.plans import page_queries
from folioscope.sources import derived, sinks
from folioscope.streaming import archives


def page(h=400, w=600):
    return np.full((h, w, 3), 255, np.uint8)


def test_colours():
    img = page()
    img[100:160, 100:180] = (10, 40, 220)  # red, as BGR
    img[300:310, 300:340] = (200, 60, 20)
    assert image.red_mask(img).sum() == 60 * 80 and image.blue_mask(img).sum() == 10 * 40
    assert [tuple(image.hsv(np.array([[p]], np.uint8))[0, 0]) for p in ((0, 0, 255), (0, 255, 0), (255, 0, 0), (9, 9, 9))] == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 9)]


def test_seals_and_fragments():
    img = page()
    img[100:160, 100:180] = (10, 40, 220)
    (s,) = image.seals(img)
    assert (s["x"], s["y"], s["w"], s["h"], s["angle"]) == (100, 100, 80, 60, 0.0) and s["fill"] > 0.99 and s["rect"] > 0.95
    assert not image.seals(page())
    frame = {"x": 0, "y": 0, "w": 100, "h": 100, "angle": 0.0, "area": 10_000, "fill": 0.1, "rect": 1.0}
    host = {**frame, "x": 200, "fill": 0.5}
    part = {"x": 210, "y": 10, "w": 20, "h": 20, "angle": 3.0, "area": 400, "fill": 0.5, "rect": 0.3}
    assert len(image.merged([frame, {**part, "x": 10}])) == 2
    (kept,) = image.merged([part, host])
    assert (kept["w"], kept["angle"]) == (100, 0.0) and kept["fill"] == pytest.approx(0.52)


def test_merging_in_sql_is_the_loop(spark):
    df = derived.pages(spark, "/root/testdata/sf0.001", "seals").where("doc_id < '3'")
    for before, after in zip(df.collect(), image.with_merged_seals(df).collect(), strict=True):
        want = image.merged([{k: v for k, v in s.asDict().items()} for s in before.seals])
        assert [(s.seal_no, s.x, s.w, round(s.fill, 9)) for s in after.seals] == [(s["seal_no"], s["x"], s["w"], round(s["fill"], 9)) for s in want]


def test_cells_and_strokes():
    img = page()
    for x in (50, 200, 350):
        img[50:250, x : x + 2] = 0
    for y in (50, 150, 248):
        img[y : y + 2, 50:352] = 0
    img[300:302, 100:180] = 0
    cells, strokes = image.layout(img)
    assert len(cells) == 4 and all(140 <= c["w"] <= 150 and 90 <= c["h"] <= 100 for c in cells)
    assert {(s["x"], s["y"], s["w"]) for s in strokes} >= {(100, 300, 80)}


@pytest.mark.parametrize("deg", [-3.0, 0.0, 2.0])
def test_skew(deg):
    img = page(500, 800)
    for y in (100, 200, 300):
        for x in range(100, 700):
            yy = int(round(y + (x - 100) * np.tan(np.deg2rad(deg))))
            img[yy : yy + 3, x] = 0
    assert abs(image.skew(img) - deg) <= 0.6
    assert image.straightened(3.0) and not image.straightened(0.2) and not image.straightened(20.0)


def test_degraded_crops():
    img = page(60, 60)
    img[10:50, 10:50] = (10, 40, 220)
    img[10:20, 10:20] = 255
    assert (image.degraded(img, "upside_down", 1)[-11, -11] == 255).all()
    for how in ("chipped", "blurred", "faint"):
        out = image.degraded(img, how, 3)
        assert out.shape == img.shape and (out != img).any() and (out == image.degraded(img, how, 3)).all()


def test_seal_features_and_windows():
    img = page(60, 90)
    img[10:50, 10:50] = (10, 40, 220)
    f = image.seal_features(img)
    assert f.shape == (32 * 32 + 16 * 16 + 9,) and f[1280] == 1.5 and f[1281] == pytest.approx(1600 / 5400) and f[1285:].sum() > 0
    assert image.seal_features(np.repeat(np.repeat(img, 3, 0), 3, 1))[1282] < f[1282]
    assert image.normalised(img, 45).shape == (30, 45, 3) and (image.resized(np.full((7, 9), 3.0), 4, 5) == 3).all()
    assert image.crop_window((10, 10, 40, 20), 60, 90) == (4, 4, 56, 36) and image.crop_window((0, 0, 5, 5), 60, 90) is None


def test_measured_rows(spark):
    img = page(200, 300)
    img[50:90, 50:110] = (10, 40, 220)
    df = spark.createDataFrame([("a", 200, 300, 3, img.tobytes()), ("bad", 5, 5, 3, b"x"), ("grey", 10, 10, 1, bytes(100))], "origin string, height int, width int, nChannels int, data binary")
    out = {r.origin: r for r in image.measured(df).collect()}
    assert out["a"].red_ratio == pytest.approx(2400 / 60_000) and out["a"].seals[0].w == 60 and out["bad"].red_ratio is None and out["grey"].seals == []


def test_report_ledger_and_gold(spark, tmp_path):
    rows = [("r", "d", 2, "A02", "LOW", "a,b", 1), ("r", "d", 1, "A01", "HIGH", 'say "x"\nnow', 2)]
    found = spark.createDataFrame(rows, "run_id string, doc_id string, page_no int, rule_id string, level string, message string, seq int")
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page_no int")
    sinks.write_report(found, pages, str(tmp_path / "report"))
    report = json.loads(spark.read.text(str(tmp_path / "report")).first().value)
    assert report["stats"]["findings"] == 2 and [x["rule_id"] for x in report["findings"]] == ["A01", "A02"]
    lines = [r.value for r in sinks.ledger_csv(found.withColumnRenamed("seq", "no"), ("no", "doc_id", "message")).collect()]
    assert lines == ["﻿no,doc_id,message\r", '1,d,"a,b"\r', '2,d,"say ""x"" now"\r']
    gold = spark.createDataFrame([("d", 1, "A", "positive", False), ("d", 2, "B", None, True)], "doc_id string, page_no int, rule_id string, kind string, unsure boolean")
    assert json.loads(sinks.gold_json(gold).first().value) == {"findings": [{"doc_id": "d", "page_no": 1, "rule_id": "A"}], "false_positives": [], "unsure": [{"doc_id": "d", "page_no": 2, "rule_id": "B"}]}


def test_rules_on_a_stream(spark, tmp_path):
    pages = page_queries.pages_for(spark, "/root/testdata/sf0.001", "lines").limit(200)
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    q = archives.page_findings(stream, "A01").writeStream.format("memory").queryName("stream_findings").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_findings").count() == archives.page_findings(spark.read.parquet(str(tmp_path / "in")), "A01").count() > 0


def test_archives_close_when_quiet(spark, tmp_path):
    schema = "doc_id string, page_no int, part string, form string, current int"
    rows = [("d", 1, "x", "f", 1), ("d", 2, None, "f", 2), ("d", 3, "y", "f", None), ("e", 1, None, "g", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = archives.closing_units(stream, 500).writeStream.format("memory").queryName("stream_units").outputMode("append").trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and spark.table("stream_units").count() < 3:
        time.sleep(0.5)
    q.stop()
    assert {(r.doc_id, r.unit_no, r.pages) for r in spark.table("stream_units").collect()} == {("d", 1, "1,2"), ("d", 2, "3"), ("e", 1, "1")}


def test_rates_by_window(spark):
    df = spark.createDataFrame([("A01", "2024-01-01 00:01:00"), ("A01", "2024-01-01 00:02:00"), ("A01", "2024-01-01 00:07:00")], "rule_id string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in archives.finding_rates(df).collect()) == [1, 2]
