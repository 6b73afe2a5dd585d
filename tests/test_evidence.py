"""Evidence crops, PNG, reports by archive; small readers and counts."""

import base64
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import cli
from folioscope.operators import image
from folioscope.sources import evidence, labels, tables

FOUND = "doc_id string, page_no int, rule_id string, level string, title string, clause string, message string, confidence double, box struct<x:int,y:int,w:int,h:int>"


def test_png_is_what_others_read(spark, tmp_path):
    img = np.random.default_rng(1).integers(0, 256, (37, 53, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(evidence.png(img))
    r = spark.read.format("image").load(str(tmp_path / "a.png")).select("image.*").first()
    assert (image.pixels(r.height, r.width, r.nChannels, bytes(r.data)) == img).all()


def test_crops_show_the_box():
    img = np.full((400, 1000, 3), 255, np.uint8)
    red = lambda a: (a == (0, 0, 255)).all(axis=2)
    out = evidence.crop(img, (300, 150, 100, 60))
    assert out.shape == (60 + 2 * 60, 100 + 2 * 70, 3)
    ys, xs = np.nonzero(red(out))
    assert (ys.min(), xs.min(), ys.max(), xs.max()) == (59, 69, 121, 171) and red(out).sum() == 103 * 63 - 97 * 57
    assert evidence.crop(img, (0, 0, 20, 20)).shape == (70, 90, 3) and evidence.crop(img, (990, 390, 500, 500)).shape[:2] == (400, 260)
    assert evidence.crop(img, None).shape == (360, 900, 3) and not red(evidence.crop(img, (5000, 5000, 5, 5))).any()
    page = evidence.crop(img, (300, 150, 100, 60), full=True, max_width=2000)
    assert page.shape == img.shape and red(page).any() and not red(img).any()


def test_reports_count_all_and_show_the_worst(spark, tmp_path):
    box = (10, 10, 40, 20)
    rows = [("D/1", 1 + i % 3, f"A{i % 4:02}", ["LOW", "HIGH", "CRITICAL"][i % 3], "a <b>", 'say "x" & y', f"m{i} <script>", 0.5, box if i % 2 else None) for i in range(30)]
    rows += [("D2", 1, "U01", "HIGH", "t", "", "unit", 0.7, None)]
    found = spark.createDataFrame(rows, FOUND).repartition(4)
    pages = spark.createDataFrame([("D/1", 1), ("D/1", 2), ("D/1", 3), ("D2", 1), ("clean", 1)], "doc_id string, page_no int")
    img = np.full((100, 200, 3), 255, np.uint8)
    images = spark.createDataFrame([("D/1", n, 100, 200, 3, img.tobytes()) for n in (1, 2)] + [("D/1", 3, 5, 5, 3, b"broken")], "doc_id string, page_no int, height int, width int, nChannels int, data binary")
    out = {r.doc_id: r.value for r in evidence.reports(found, pages, images, max_shown=12, max_crops=11, language="zh").collect()}
    one = out["D/1"]
    assert set(out) == {"D/1", "D2", "clean"} and "<script>" not in one and "&lt;script&gt;" in one and "say &quot;x&quot; &amp; y" in one
    assert one.count("<article") == 12 and "18 more in the full list" in one and one.count('class="CRITICAL"') == 10 and one.count('class="HIGH"') == 2
    assert "<tr><td>严重</td><td>10</td></tr>" in one and "<tr><td>A00</td><td>8</td></tr>" in one and "3 pages, 30 findings" in one
    pictures = re.findall(r"base64,([^\"]+)", one)
    # ten critical findings and one high: those of page 3 have no pixels
    shown = sorted(rows[:30], key=lambda r: ({"CRITICAL": 0, "HIGH": 1, "LOW": 3}[r[3]], r[1], r[2], r[6]))[:11]
    assert len(pictures) == sum(r[1] != 3 for r in shown)
    assert all(base64.b64decode(p).startswith(b"\x89PNG") for p in pictures)
    assert "1 pages, 0 findings" in out["clean"] and "<article" not in out["clean"] and "more in" not in out["clean"]
    evidence.write_reports(spark.createDataFrame(list(out.items()), "doc_id string, value string"), str(tmp_path / "reports"))
    files = list((tmp_path / "reports").glob("archive=*/*.txt"))
    assert len(files) == 3 and sorted(f.read_text().strip() for f in files) == sorted(re.sub(r"[\r\n]+", " ", v) for v in out.values())
    plain = {r.doc_id: r.value for r in evidence.reports(found, pages).collect()}
    assert "<img" not in plain["D/1"] and plain["D/1"].count("<article") == 30


def test_names_of_levels_and_verdicts(spark):
    row = spark.range(1).select(*[F.expr(evidence.label(f"'{x}'", lang)) for x, lang in (("HIGH", "zh"), ("true", "en"), ("odd", "zh"))]).first()
    assert row[:] == ("较重", "confirmed", "odd")


def test_page_lists_fall_back_to_the_range(spark):
    rows = [("[3, 5, 9]", 3, 9), ("", 2, 4), (None, 1, 2), ("no json", 7, 7), ("[]", 1, 3), ('{"a": 1}', 2, 3), ("[1, null]", 5, 6)]
    got = spark.createDataFrame(rows, "pages string, start_page int, end_page int").select(F.expr(tables.page_list()).alias("p")).collect()
    assert [r.p for r in got] == [[3, 5, 9], [2, 3, 4], [1, 2], [7], [1, 2, 3], [2, 3], [1]]


def test_single_files_are_pages_or_errors(spark, tmp_path):
    (tmp_path / "scan 1.PNG").write_bytes(evidence.png(np.zeros((3, 4, 3), np.uint8)))
    (r,) = tables.scan_file(spark, str(tmp_path / "scan 1.PNG")).collect()
    assert (r.doc_id, r.page_no) == ("scan 1", 1)
    for name in ("x.docx", "x", "x.pdf"):
        with pytest.raises(ValueError, match="no page image"):
            tables.scan_file(spark, str(tmp_path / name))


def test_labels_by_people(spark):
    samples = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "sample_id bigint, synthetic boolean")
    given = spark.createDataFrame([(1, "王"), (2, "王"), (3, "合成"), (4, None), (9, "李")], "sample_id bigint, labeler string")
    assert labels.human_labels(samples, given).first().n == 2


def test_a_run_takes_so_many_pages(spark, tmp_path):
    from folioscope.plans import page_queries

    page_queries.pages_for(spark, "/root/testdata/sf0.001", "lines").write.parquet(str(tmp_path / "pages"))
    cli.main(["audit", str(tmp_path / "pages"), str(tmp_path / "out"), "--limit", "50"], spark)
    found = spark.read.parquet(str(tmp_path / "out"))
    first = spark.read.parquet(str(tmp_path / "pages")).orderBy("doc_id", "page_no").limit(50)
    assert found.count() > 20 and found.join(first, ["doc_id", "page_no"], "left_anti").isEmpty()
