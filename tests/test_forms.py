"""Drawn forms: the kernels measure what was drawn, the rules find what the manifest says and nothing else."""

from pyspark.sql import functions as F

from folioscope.operators import image, page_rules
from folioscope.sources import derived, forms


def test_rules_find_what_the_manifest_says(spark, tmp_path):
    rows = derived.pages(spark, "/root/testdata/sf0.001").where("doc_id < '103'").select("doc_id", "page_no")
    drawn = forms.forms(rows, seed=7, share=0.3).persist()
    n = rows.count()
    assert drawn.count() == n >= 30
    measured = image.measured(drawn).drop("height", "width")
    pages = drawn.select("doc_id", "page_no", "origin", "height", "width", "lines", "stamp").join(measured, "origin").withColumns({"form_type": F.lit("质量证明单"), "page_count": F.lit(1)}).persist()
    found = page_rules.findings(pages, *forms.FAULTS.values()).select("doc_id", "page_no", "rule_id").distinct()
    want = forms.manifest(drawn)
    assert {tuple(r) for r in found.collect()} == {(r.doc_id, r.page_no, r.rule_id) for r in want.collect()}
    assert {r.fault for r in want.select("fault").distinct().collect()} == set(forms.FAULTS)
    for r in pages.collect():
        assert len(r.seals) == (r.stamp is not None)
        for s in r.seals:
            assert abs(s.angle - r.stamp.angle) < 2.0 and abs(s.x + s.w / 2 - r.stamp.x) < 2 and abs(s.y + s.h / 2 - r.stamp.y) < 2 and s.rect > 0.9
        assert len([c for c in r.cells if c.y > 380]) == 12 and abs(r.skew) <= 0.1  # a stamp has an inside, too
    forms.write_manifest(drawn, str(tmp_path / "manifest"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "manifest"))
    assert back.columns == ["doc_id", "page_no", "fault", "rule_id"] and back.count() == want.count()


def test_a_page_depends_on_its_key_and_seed(spark):
    a, b, c = forms.draw("D", 1, 3, 0.5), forms.draw("D", 1, 3, 0.5), forms.draw("D", 2, 3, 0.5)
    assert (a[0] == b[0]).all() and a[1:] == b[1:] and not (a[0] == c[0]).all()
    assert not forms.draw("D", 1, 4, 0.0)[3]
