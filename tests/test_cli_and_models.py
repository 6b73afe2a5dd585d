"""The command line end to end, and cross-validated models."""

import json

from folioscope import cli
from folioscope.operators import model
from folioscope.plans import page_queries


def test_audit_eval_gold_export(spark, tmp_path, capsys):
    pages, out = str(tmp_path / "pages"), str(tmp_path / "findings")
    page_queries.pages_for(spark, "/root/testdata/sf0.001", "lines").limit(50).write.parquet(pages)
    cli.main(["audit", pages, out, "--run", "r1", "--rules", "A01,A06"], spark)
    cli.main(["audit", pages, out, "--run", "r2"], spark)
    found = spark.read.parquet(out)
    assert {r.run_id for r in found.select("run_id").distinct().collect()} == {"r1", "r2"} and {r.rule_id for r in found.where("run_id = 'r1'").select("rule_id").distinct().collect()} <= {"A01", "A06"}
    assert found.count() == found.select("finding_key").distinct().count()
    one = found.first()
    key = {"doc_id": one.doc_id, "page_no": one.page_no, "rule_id": one.rule_id}
    (tmp_path / "review.json").write_text(json.dumps({"reviewer": "u", "adjudications": [key | {"verdict": "true", "note": ""}]}))
    cli.main(["gold", str(tmp_path / "gold"), str(tmp_path / "review.json")], spark)
    cli.main(["eval", out, str(tmp_path / "gold")], spark)
    assert "tp=1 fp=0 fn=0" in capsys.readouterr().out
    cli.main(["export", out, str(tmp_path / "ledger")], spark)
    assert spark.read.text(str(tmp_path / "ledger")).count() == found.count() + 1


def test_groups_stay_in_one_fold(spark):
    rows = [(f"g{i % 40}", [float(i % 2) + i * 1e-4, float(i % 7)], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, features array<double>, label int")
    assert model.usable_folds(df, "g") == 5 and model.usable_folds(df.limit(0), "g") == 1
    got = model.cross_validated(df, "g", 3).collect()
    assert sum(r.n for r in got) == 400 and all(r.accuracy > 0.99 for r in got)
    folds = df.select("g", model.folds_of("g").alias("f")).distinct()
    assert folds.count() == 40
