"""Work that must not be done more than once a row: read off the plans, since small tables don't show it."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_archives_are_streamed(spark):
    """Python is entered by the batch, not by the stretch."""
    plan = _plan(__spark_entry__.queries()["wn_segment_long"](spark, SF))
    assert "MapInArrow" in plan and "GroupsInArrow" not in plan


@pytest.mark.parametrize("name", ["fn_keys", "fn_marker"])
def test_what_a_filter_reads_is_worked_out_once(spark, name):
    """No filter that is pushed below the arrays and repeats the whole expression."""
    plan = _plan(__spark_entry__.queries()[name](spark, SF))
    assert not [x for x in re.split(r"\n\s*[:+]", plan) if x.lstrip("- ").startswith("Filter") and "lambda" in x]


@pytest.mark.parametrize("name", ["a16_multi_point", "a17_rounding"])
def test_arrays_are_built_outside_lambdas(spark, name):
    """the pages' arrays are compiled in a projection of their own, not interpreted within a lambda."""
    plan = _plan(__spark_entry__.queries()[name](spark, SF))
    built = [x for x in plan.splitlines() if "测量7点" in x]
    assert built and not any("lambda" in x for x in built)


def test_strokes_do_not_build_lines_anew(spark):
    """nothing within the lambda over strokes builds the page's lines."""
    plan = _plan(__spark_entry__.queries()["b06_struck_lines"](spark, SF))
    assert not [x for x in plan.splitlines() if "净重" in x and "lambda" in x]


def test_an_empty_number_is_null_without_a_cast(spark):
    """an empty text never reaches the cast, whose exception costs more than the match."""
    from folioscope.functions import text as t

    df = spark.createDataFrame([("",), ("７",), ("12",), ("99999999999",), (None,)], "s string")
    assert [r[0] for r in df.select(F.expr(t.number("s"))).collect()] == [None, 7, 12, None, None]
    assert "<> ''" in t.number("s")


@pytest.mark.parametrize("name", ["all_text_rules", "odd_pages", "audit_findings", "audit_report"])
def test_rules_ask_no_unicode_library(spark, name):
    """lower() of a plain token took half of the rules' time."""
    from folioscope.operators import page_rules

    assert "lower(" not in page_rules.RULES["A10"]
    assert "lower(" not in _plan(__spark_entry__.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["dml_gold_merge"])
def test_an_aggregate_does_not_sort_beside_the_window_that_made_its_rows(spark, name):
    """two sorts in one stage take the memory of two; rows are dealt by key first."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    operators = re.findall(r"^[\s:*()\d+-]*([A-Z]\w+)", plan, re.M)
    stage = operators[operators.index("Exchange") : operators.index("Window")]
    assert "SortAggregate" not in stage and "Sort" not in stage


@pytest.mark.parametrize("name", ["all_text_rules", "odd_pages", "audit_findings"])
def test_methods_are_short_enough_to_be_compiled(spark, name):
    """Round 4, F1, F3: a method of more than 8,000 bytes is interpreted for good."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the stages' code is there before the run
    try:
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert stages.size() and max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000


@pytest.mark.parametrize("name", ["all_text_rules", "odd_pages", "audit_findings"])
def test_rules_over_single_lines_are_compiled(spark, name):
    """Round 4, F1 to F4: such a rule reads an exploded line, not a lambda's, and no filter repeats what makes an array."""
    plan = _plan(__spark_entry__.queries()[name](spark, SF))
    assert "Contains(l#" in plan and re.search(r"Generate explode\(\w*lines#", plan)
    assert not [x for x in re.split(r"\n\s*[:+]", plan) if x.lstrip("- ").startswith("Filter") and "lambda" in x]


def test_repeats_go_whatever_way_lines_are_read(spark):
    """Round 4, F1: findings of lines that share a box or a number lose their repeats as those of one line do; those of other lines stay."""
    from folioscope.operators import audit

    line = "array<struct<line_no:int,text:string,x:int,y:int,w:int,h:int>>"
    rows = [
        ("one", [(1, "2023-6-1 2023-6-1", 0, 0, 9, 9), (2, "2023-6-1", 0, 20, 9, 9)]),
        ("box", [(1, "2023-6-1", 0, 0, 9, 9), (2, "2023-6-1", 0, 0, 9, 9), (3, "2023-6-2", 0, 0, 9, 9)]),
        ("number", [(1, "2023-6-1", 0, 0, 9, 9), (1, "2023-6-1", 0, 20, 9, 9), (None, "2023-6-1", 0, 40, 9, 9)]),
        ("far", [(1, "2023-6-1", 2**31 - 1, 0, 9, 9), (2, "2023-6-1", None, 0, 9, 9)]),
        ("none", None),
    ]
    df = spark.createDataFrame([(doc, 1, "质量证明单", lines) for doc, lines in rows], f"doc_id string, page_no int, form_type string, lines {line}")
    got = sorted(((r.doc_id, r.message.split(": ")[1], r.box and r.box.y) for r in audit.page_findings(df, "A01").collect()), key=repr)
    assert got == [("box", "2023-6-1", 0), ("box", "2023-6-2", 0), ("far", "2023-6-1", 0), ("far", "2023-6-1", 0), ("none", "could not be checked", None), ("number", "2023-6-1", 0), ("number", "2023-6-1", None), ("one", "2023-6-1", 0), ("one", "2023-6-1", 20)]


def test_digests_ask_for_plain_words_first(spark):
    """Round 4, F1, F2: no expression over the whole page where a plain search tells."""
    from folioscope.functions import text as t
    from folioscope.operators import classify

    assert all(any(w in f for w in classify.KEY_SIGNS) for f in classify.KEY_FIELDS)
    assert "rlike" not in classify.has_title()
    texts = ["一二三四五六七八九十" * 2, " ".join("一二三四五六七八九十" * 2), "一二三四五　六七\t八九十 \n一二三四五六 七八九十", "短"]
    a, b, c, d = (r[0] for r in spark.createDataFrame([(x,) for x in texts], "s string").select(F.expr(t.fingerprint("s"))).collect())
    assert a == b == c != "" and d == ""
    assert "replace(replace(" in t.fingerprint("s")
