"""The pipeline's stages on planted cases, each against what its operator must do."""

import corpus_pipeline as cp
import pytest

from folioscope.llm import bpe, neardup


@pytest.fixture(scope="module")
def corpus(spark, words, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    bench = [(1, words(900, 30)), (2, words(901, 20))]
    docs = [(i, words(i, 60) + ".", "en", "s", 1) for i in range(120)]
    docs += [(200 + i, words(i, 60) + ".", "en", "s", 1) for i in range(10)]  # exact copies
    docs += [(300 + i, words(i + 20, 60).replace(words(i + 20, 60).split()[30], "changed", 1) + ".", "en", "s", 1) for i in range(10)]  # near copies
    docs += [(400, words(70_000, 80) + " " + words(900, 30) + " end", "en", "s", 1), (401, words(901, 20), "en", "s", 1)]
    docs += [(500, words(70_001, 40) + " mail me at jo.doe@mail.example.com", "en", "s", 1)]
    docs += [(600 + i, " ".join(w.upper() + "!!" for w in words(i, 50).split()), "en", "s", 1) for i in range(60)]
    docs += [(700, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(600 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_one_by_one(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, corpus).cache()
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept[name] = {r.doc_id: r for r in out.collect()}
        docs = out
    good, distinct, clean, private, coded = kept.values()
    assert not [i for i in good if i is not None and i >= 600 and i < 700] and set(range(120)) <= set(good)
    plain = [(r.doc_id, r.text) for r in good.values()]
    assert set(distinct) == {d for d, n, c, k in neardup.brute_force(plain, 5, 80) if k}
    assert set(range(120)) <= set(distinct) and not any(200 <= i < 320 for i in distinct)
    assert 401 not in clean and clean[400].text.endswith(" end") and len(clean[400].text) < len(distinct[400].text)
    assert all(clean[i].text == distinct[i].text for i in range(120))
    assert "jo.doe" not in private[500].text and private[500].n_chars == len(private[500].text)
    assert all(private[i].text == clean[i].text for i in range(120))
    for i, r in coded.items():
        n, _, _ = bpe.library_answer(private[i].text)
        assert r.n_tokens == n


def test_run_is_the_stages_in_turn(spark, corpus):
    from pathlib import Path

    from folioscope.llm.common import shared_dir

    folder = Path(f"{shared_dir(spark)}/folioscope")
    before = {x.name for x in folder.iterdir()} if folder.exists() else set()
    out = cp.run(spark, corpus)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 100
    left = {x.name for x in folder.iterdir()} - before
    assert len(left) == 1 and left.pop().startswith("stage-byte-pair")


@pytest.mark.parametrize("case", ["empty", "no benchmark", "repeats", "clashes"])
def test_odd_tables_run(spark, words, tmp_path, case):
    docs = [] if case == "empty" else [(i, words(i, 40) + ".", "en", "s", 1) for i in range(12)] + [(None, words(99, 30), None, None, None)]
    if case == "repeats":
        docs += [docs[1]] * 5 + [(1, words(77, 40), "en", "s", 1)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2)
    if case == "clashes":
        from pyspark.sql import functions as F

        for name in ("score", "kept", "_row", "_text", "row", "report", "n", "k", "items", "entities", "class", "key", "ids", "keys", "a.b", "text.x", "two words", "_row.text"):
            table = table.withColumn(name, F.lit(name))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    bench = [] if case == "no benchmark" else [(1, words(900, 30))]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from folioscope.llm.common import settle

    done = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        done = settle(stage(spark, done, str(tmp_path)), "case")
        assert name == cp.STAGES[-1][0] or done.columns == table.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in done.collect())
    want = [(False, i) for i in range(12)] * (case != "empty") + [(True, 0)] * (case != "empty")
    assert got == sorted(want + [(False, 1)] * (case == "repeats"))
