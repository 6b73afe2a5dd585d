"""Every query against its SQL twin on the smallest tables, and the driver's contract."""

import datetime

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


def test_every_sql_has_a_query_and_the_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(5).count() == 5


def test_rules_share_one_scan_without_python(spark):
    plan = entry.queries()["all_text_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_missing_library_takes_only_the_llm_queries(monkeypatch):
    def lacking(name):
        def fail(_):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return fail

    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: object())
    monkeypatch.setattr(entry.importlib, "import_module", lacking("ahocorasick"))
    with pytest.warns(UserWarning, match="ahocorasick"):
        assert entry._optional("folioscope.llm.queries") is None
    monkeypatch.setattr(entry.importlib, "import_module", lacking("folioscope.llm.gone"))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("folioscope.llm.queries")
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert entry._optional("folioscope.llm.queries") is None
