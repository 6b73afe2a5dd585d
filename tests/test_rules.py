"""Page rules on hand-made pages: what must be flagged and what must not."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import classify, page_rules
from folioscope.plans import catalog as c

LINE = "array<struct<line_no:int,text:string,x:int,y:int,w:int,h:int>>"
CELL = "array<struct<cell_no:int,content:string,x:int,y:int,w:int,h:int,ink:double>>"
SEAL = "array<struct<seal_no:int,x:int,y:int,w:int,h:int,angle:double,area:int,fill:double,rect:double>>"
SEGMENT = "array<struct<seg_no:int,x:int,y:int,w:int,h:int>>"
SCHEMA = f"doc_id string, page_no int, page_count int, form_type string, width int, height int, red_ratio double, blue_ratio double, lines {LINE}, cells {CELL}, seals {SEAL}, segments {SEGMENT}"


@pytest.fixture(scope="module")
def run(spark):
    def check(rule, lines=(), cells=(), seals=(), segments=(), form="质量证明单", pages=1, page_no=1, red=0.0, blue=0.0, width=1000, height=1400):
        placed = [(i, *(t if isinstance(t, tuple) else (t, 100, 100 + 40 * i, 300, 30))) for i, t in enumerate(lines)]
        number = lambda xs: [(i, *x) for i, x in enumerate(xs)]
        row = ("D", page_no, pages, form, width, height, red, blue, placed, number(cells), number(seals), number(segments))
        return page_rules.findings(spark.createDataFrame([row], SCHEMA), rule).collect()

    return check


@pytest.mark.parametrize(
    ("rule", "bad", "good"),
    [
        ("A01", ["2023.6.1", "2022-04-24", "2023/06/01", "2021.8.20"], ["2023.06.01", "2021 年 08 月 20 日", "1409-1072", "2021-407-", "602A-1636", "2112-407-BMJ2891", "GB/T4162-2008", "2023.13.40"]),
        ("A02", ["15℃-20℃", "36.1HRC-39.5HRC", "0.5-0.6MPa", "Φ50-Φ60"], ["15℃～20℃", "22-02-10-7", "PN-3811B", "1409-1072", "Z01220214071", "26.29～26.49"]),
        ("A03", ["φ48.00", "ø3"], ["Φ48.00"]),
        ("A04", ["Φ50.02～50.06", "Φ1~2"], ["Φ50.02～Φ50.06"]),
        ("A05", ["5mm", "5 mm 长"], ["5mm/s", "5mmx"]),
        ("A06", ["净重 30Kg", "10 MPA"], ["净重 30kg", "30Kgf"]),
        ("A07", ["面积 5m2", "5 m³"], ["5m23", "5m"]),
        ("A08", ["重量三十公斤", "约二 米"], ["重量30kg"]),
        ("A11", ["10(-0.1~0.1)", "5(-0.20～+0.2)"], ["10(-0.1~0)"]),
        ("A13", ["复印件与原件一致", "与 原件相符"], ["此件与原件一致", "正常"]),
    ],
)
def test_text_rules(run, rule, bad, good):
    for text in bad:
        assert run(rule, [text]), (rule, text)
    for text in good:
        assert not run(rule, [text]), (rule, text)


def test_full_width_digits_count(run):
    assert [r.detail for r in run("A01", ["2023-０６-０１", "2023-１３-０１"])] == ["2023-０６-０１"]


def test_every_match_is_a_finding(run):
    assert len(run("A01", ["2023-06-01 至 2023-07-01"])) == 2


def test_page_number_rule(run):
    flagged = lambda *lines, pages=4: bool(run("A09", [*lines, "a", "b"], pages=pages))
    assert flagged("第1页") and not flagged("第1页", pages=1) and not flagged("无页码")
    for text in ("第1页共4页", "共4页第1页", "共2页、第2页", "（共2页、第1页）", "共1页"):
        assert not flagged(text), text
    assert not run("A09", ["第1页"], pages=4)  # a blank page


def test_decimals(run):
    for text, bad in (("称重 12.34567", True), ("称重 12.345", False), ("称重 PN12.34567", False), ("称重 1.2.34567", False), ("称重 12.34567kg", True), ("称重 12.34567号码X9", True)):
        assert bool(run("A10", [text])) == bad, text
    assert not run("A10", ["12.34567"])


def test_column_rules(run):
    head = [("实际", 600, 300, 80, 30), ("规定", 400, 300, 80, 30)]
    at = lambda text, x, y: (text, x, y, 80, 30)
    assert [r.evidence for r in run("A14", [*head, at("合格", 600, 400), at("26.35", 600, 440)])] == ["合格"]
    assert not run("A14", [*head, at("26.35", 600, 400), at("26.41", 600, 440)])
    assert [r.evidence for r in run("A15", [*head, at("流量", 100, 400), at("3.1", 600, 400), at("0.020", 600, 600)])] == ["3.1"]
    assert not run("A15", [*head, at("流量", 100, 400), at("3.1m3/h", 600, 400)])
    assert run("A16", [*head, at("R5(2处)", 100, 400), at("R5.02～R5.06", 600, 400)])
    assert not run("A16", [*head, at("R5(2处)", 100, 400), at("R5.02 R5.06", 600, 400)]) and not run("A16", [*head, at("测量12点", 100, 400), at("1～2", 600, 400)])
    assert run("A17", [*head, at("26.39±0.1", 400, 400), at("26.3", 600, 400)])
    assert not run("A17", [*head, at("26.39±0.1", 400, 400), at("26.35", 600, 400)]) and not run("A17", [*head, at("0.035", 400, 400), at("0.0 30", 600, 400)])


def test_column_takes_the_cell_and_the_lowest_header(run):
    lines = [("实际", 600, 100, 80, 30), ("实际", 600, 300, 80, 30), ("合格", 520, 200, 60, 30), ("1.5", 600, 400, 60, 30), ("合格", 900, 400, 60, 30)]
    assert not run("A14", lines)  # the verdicts are above the header or outside the column
    assert run("A14", lines, cells=[("", 500, 290, 500, 50, 0.0)])


def test_special_record_and_reviewer(run):
    assert run("A12", [("特殊记载", 100, 400, 100, 30)]) and not run("A12", [("特殊记载：无", 100, 400, 100, 30)])
    assert not run("A12", [("特殊记载", 100, 400, 100, 30), ("见附页", 400, 410, 100, 30)])
    copy = ("此件与原件一致", 700, 1200, 200, 30)
    label = ("复核人", 100, 400, 100, 30)
    assert run("A18", [copy, label]) and not run("A18", [label])
    assert not run("A18", [copy, label, ("李四", 300, 400, 60, 30)]) and run("A18", [copy, label, ("：", 300, 400, 60, 30)])
    assert not run("A18", [copy, label], seals=[(300, 390, 60, 60, 0.0, 1000, 0.5, 0.9)])


def test_stamps(run):
    seal = lambda x, y, angle=0.0, fill=0.5, rect=0.9, w=60, h=60, area=2000: (x, y, w, h, angle, area, fill, rect)
    assert run("B01", seals=[seal(0, 0, 12.0)]) and not run("B01", seals=[seal(0, 0, 12.0, rect=0.5), seal(0, 0, 12.0, fill=0.1), seal(0, 0, 9.0)])
    assert len(run("B02", seals=[seal(0, 0), seal(10, 0), seal(500, 0)])) == 1 and not run("B02", seals=[seal(0, 0), seal(10, 0, area=100)])
    assert run("B03", [("2023.06.01", 100, 100, 100, 30)], seals=[seal(100, 90)]) and not run("B03", [("编号", 100, 100, 100, 30)], seals=[seal(100, 90)])
    assert run("B05", ["与原件一致"]) and not run("B05", [("与原件一致", 600, 1200, 200, 30)])
    three = ["a", "b", "c"]
    assert run("B08", three) and not run("B08", three, red=0.001) and not run("B08", [*three, "此件与原件一致"]) and not run("B08", ["a"])
    assert run("B10", three, blue=0.001) and not run("B10", three)
    head = ("检验员", 800, 300, 80, 30)
    assert run("B07", [head, ("a", 100, 400, 80, 30), ("b", 100, 500, 80, 30)])
    assert not run("B07", [head, ("a", 100, 400, 80, 30), ("b", 100, 500, 80, 30)], seals=[seal(810, 500)])
    assert not run("B07", [head, ("a", 100, 400, 80, 30)])


def test_blank_cells(run):
    label, blank = ("零件号", 100, 100, 80, 40, 0.1), ("", 190, 100, 80, 40, 0.0)
    assert [r.evidence for r in run("B04", cells=[label, blank])] == ["零件号"]
    assert not run("B04", cells=[label, (*blank[:5], 0.01)]) and not run("B04", cells=[("操作者", *label[1:]), blank])
    column = [label] + [("", 100, 150 + 50 * i, 80, 40, 0.0) for i in range(3)]
    assert [(r.no, r.detail) for r in run("B04", cells=column)] == [(None, "3")]
    assert not run("B04", cells=[label, blank], seals=[(190, 100, 60, 40, 0.0, 900, 0.5, 0.9)])


def test_struck_lines_and_number_position(run):
    lines = [(f"行{i}", 100, 100 + 40 * i, 200, 30) for i in range(5)]
    struck = [(110, 113 + 40 * i, 150, 3) for i in range(5)]
    assert [r.detail for r in run("B06", lines, segments=struck)] == ["5"] and not run("B06", lines, segments=struck[:3])
    assert not run("B06", lines, segments=[(110, 113 + 40 * i, 20, 3) for i in range(5)])
    assert run("B09", [("第1页", 10, 1350, 60, 30)]) and not run("B09", [("第1页", 470, 1350, 60, 30)])


def test_form_rules(run):
    assert run("F01", cells=[("装配处", 100, 100, 80, 40, 0.1), ("/", 190, 100, 80, 40, 0.1)]) and not run("F01", cells=[("装配处", 100, 100, 80, 40, 0.1), ("A", 190, 100, 80, 40, 0.1)])
    assert run("F02", ["a", "b", "c"]) and not run("F02", ["a", "b", "设计图版次：A"]) and not run("F02", ["a", "b", "c"], form="检验记录")
    assert run("F03", ["呈报单"]) and not run("F03", ["呈报单", "共3页"])
    assert run("F06", ["a", "b", "零件号"], form="检验记录")[0].detail == "批次" and not run("F06", ["a", "b", "c"], form="检验记录", page_no=2)
    assert run("F07", ["超差"]) and not run("F07", ["超差", "拒收单 3"])
    assert run("F08", ["36HRC"]) and not run("F08", ["36～38HRC"]) and run("F08", ["36～38HRC", "抽检"]) and not run("F08", ["36HRC", "抽检 3"])
    assert run("F12", ["呈报"], form="产品合格证") and not run("F12", ["呈报已闭环"], form="产品合格证")


def test_gating(run):
    assert not run("A01", ["2023-06-01"], form="产品合格证") and run("A01", ["2023-06-01"], form="未识别")


def test_whole_catalog_runs_on_text_alone(spark):
    row = ("D", 1, 2, "检验记录", 1000, 1400, 0.0, 0.0, [(0, "2023-06-01 φ3", 1, 1, 9, 9)])
    df = spark.createDataFrame([row, row[:8] + (None,), row[:8] + ([],)], SCHEMA.split(", cells")[0])
    assert {r.rule_id for r in page_rules.findings(df).collect()} >= {"A01", "A03"}


def test_catalog_changes():
    book = c.with_packs(c.BOOK, {"A12": {"enabled": "yes", "params": {"a": 1}}}, {"A12": {"level": "LOW"}})
    assert book["A12"].enabled and book["A12"].level == "LOW" and book["A12"].params == {"a": 1} and not c.BOOK["A12"].enabled
    over = c.with_overrides(book, {"A12": {"enabled": None, "level": "HIGH", "params": "no json"}, "Z99": {"level": "LOW"}})
    assert over["A12"].enabled and over["A12"].level == "HIGH" and over["A12"].params == {"a": 1}
    assert c.difference(c.BOOK["A10"], {"max_decimals": 4}) == {"max_decimals": 4} and c.difference(c.BOOK["A10"], {"max_decimals": 3}) == {}
    with pytest.raises(ValueError):
        c.difference(c.BOOK["A10"], {"decimals": 4})
    for bad in ({"Z99": {}}, {"A01": {"level": "SEVERE"}}):
        with pytest.raises(ValueError):
            c.with_packs(c.BOOK, bad)
    assert c.fingerprint(("a", b"x")) != c.fingerprint(("b", b"x")) and [c.truth(x) for x in ("off", "No", "", "on", 0, 1)] == [False, False, False, True, False, True]


@pytest.mark.parametrize(("text", "marker"), [("第1页共4页", (1, 4)), ("共 4 页 第 2 页", (2, 4)), ("1/1份-13/19页", (13, 19)), ("5/3页", None), ("第1页", None)])
def test_markers(spark, text, marker):
    row = spark.createDataFrame([([(0, text, 0, 0, 1, 1)], text)], f"lines {LINE}, page_text string")
    got = row.select(F.expr(classify.marker("lines", "page_text")).alias("m")).first().m
    assert (tuple(got) if got else None) == marker


def test_marker_split_over_lines_and_forms(spark):
    df = spark.createDataFrame([([(0, "第2页", 0, 900, 1, 1), (1, "共5页", 0, 950, 1, 1), (2, "检验记录", 0, 10, 9, 9)], "第2页\n共5页", 1000)], f"lines {LINE}, page_text string, height int")
    forms = classify.Forms((("甲", ("检验",)), ("乙", ("页",)))).merged(classify.Forms((("丙", ("没有",)),), (("丁", ("第", "共")),)))
    got = df.select(F.expr(classify.marker("lines", "page_text")).alias("m"), F.expr(forms.sql()).alias("f"), F.expr(classify.has_title()).alias("t")).first()
    assert tuple(got.m) == (2, 5) and got.f == "甲" and got.t
    assert [n for n, _ in forms.patterns] == ["丙", "甲", "乙"]
