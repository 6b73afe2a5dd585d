"""Archives that close by event time: late pages, restarts, and the batch's units and findings."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import segment
from folioscope.streaming import archives

DIGEST = "doc_id string, page_no int, form_type string, keys map<string,string>, marker struct<current:int,total:int>, has_title boolean, text_len int, fingerprint string, ts timestamp"


@pytest.fixture
def rocks(spark):
    for k, v in archives.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in archives.STORE:
        spark.conf.unset(k)


def test_closed_archives_are_those_of_the_batch(rocks, tmp_path):
    spark, r = rocks, random.Random(6)
    pages = []
    for a in range(4):
        for no in range(1, 13):
            marker = r.choice([None, (r.randint(1, 4), 4)])
            pages.append((f"D{a}", no, r.choice(["质量证明单", "检验记录"]), {"批次号": r.choice("12")} if r.random() < 0.4 else {}, marker, False, 80, r.choice(["", "f1", "f2"])))
    r.shuffle(pages)
    late = [p for p in pages if p[0] == "D1" and p[1] in (3, 7)]
    at = lambda minute: f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00"
    folder = tmp_path / "in"

    def add(rows):
        spark.createDataFrame(rows, DIGEST.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(DIGEST).parquet(str(folder))
        closed = archives.revisions(stream, late="1 minute", quiet_ms=300_000)
        # a new query from the checkpoint each time
        query = archives.write_closed(closed, str(tmp_path / "units"), str(tmp_path / "found"), str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    tick = lambda minute: [("tick", minute, "检验记录", {}, None, False, 80, "", at(minute))]
    first = [p for p in pages if p not in late]
    add([(*p, at(1)) for p in first[:20]])
    add([(*p, at(3)) for p in first[20:]] + [(*first[0], at(3))])  # one page twice
    add(tick(30))
    units = spark.read.parquet(str(tmp_path / "units"))
    assert {(x.doc_id, x.revision) for x in units.collect()} == {(f"D{a}", 1) for a in range(4)}
    add([(*p, at(31)) for p in late])
    add(tick(60))
    batch = spark.createDataFrame([(*p, None) for p in pages], DIGEST).drop("ts")
    want = segment.units(segment.page_units(batch))
    mine = lambda df: sorted(map(str, df.where("doc_id <> 'tick'").select("unit_id", "pages", "declared_total", "form_type").collect()))
    units, found = spark.read.parquet(str(tmp_path / "units")), spark.read.parquet(str(tmp_path / "found"))
    assert {(x.doc_id, x.revision) for x in units.where("doc_id <> 'tick'").collect()} == {("D0", 1), ("D1", 1), ("D1", 2), ("D2", 1), ("D3", 1)}
    assert mine(archives.latest(units, units)) == mine(want)
    told = lambda df: sorted(map(str, df.where("doc_id <> 'tick'").select("doc_id", "unit_id", "rule_id", "page_no", "detail").collect()))
    assert told(archives.latest(found, units)) == told(segment.findings(want)) != []
