"""Audit pages made from the driver's star schema: a lineitem is a page, an order an archive.

PAGE is SQL that Spark and other engines run alike. A page's lines, cells, seals and strokes are given as (number, text or
content, geometry) expressions over PAGE's columns; Spark nests them as arrays in the page row, so a rule reads one row
and nothing is shuffled, and the SQL twin unnests the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

PAGE = """
SELECT CAST(l_orderkey AS STRING) AS doc_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS page_no,
  CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS page_count,
  CASE l_returnflag WHEN 'R' THEN '质量证明单' WHEN 'A' THEN '检验记录' ELSE '产品合格证' END AS form_type,
  1000 AS width, 1400 AS height,
  CAST(l_partkey AS INT) AS p, CAST(l_suppkey AS INT) AS s, l_linenumber AS n, CAST(l_quantity AS INT) AS q,
  CAST(year(l_shipdate) AS INT) AS yy, CAST(month(l_shipdate) AS INT) AS mm, CAST(day(l_shipdate) AS INT) AS dd,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_linenumber END AS marker,
  CAST(max(l_linenumber) OVER (PARTITION BY l_orderkey) AS INT) AS total,
  CAST(l_partkey % 50 AS DOUBLE) / 1000000 AS red_ratio, CAST(l_suppkey % 20 AS DOUBLE) / 10000 AS blue_ratio,
  CAST(l_partkey % 30 AS DOUBLE) / 10000 AS column_red, CAST(l_suppkey % 25 AS DOUBLE) / 10000 AS row_red
FROM lineitem
"""


def _pick(of: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"(CASE {of} % {len(values)} {cases} ELSE {values[-1]} END)"


_S = lambda x: f"CAST({x} AS STRING)"
_Q, _Q1 = _S("q"), _S("q + 1")
_SEP = _pick("n", "'.'", "'-'", "'/'")

#: (number, text, x, y, w, h)
TEXT_LINES = (
    (1, f"{_S('yy')} || {_SEP} || {_pick('p', f'''lpad({_S('mm')}, 2, '0')''', _S('mm'))} || {_SEP} || lpad({_S('dd')}, 2, '0')", "100", "80", "300", "30"),
    (2, f"{_Q} || {_pick('s', chr(39) + '～' + chr(39), chr(39) + '-' + chr(39), chr(39) + '－' + chr(39))} || {_Q1} || {_pick('p', chr(39) * 2, chr(39) + 'kg' + chr(39), chr(39) + 'HRC' + chr(39), chr(39) + '℃' + chr(39))}", "100", "120", "300", "30"),
    (3, _pick("p", f"'φ' || {_Q} || '.5'", f"'Φ' || {_Q} || '-' || {_Q1}", f"'Φ' || {_Q} || '～' || {_Q1}", f"'Φ' || {_Q} || '～Φ' || {_Q1}", f"'ø' || {_Q}"), "100", "160", "300", "30"),
    (4, f"'长' || {_Q} || {_pick('s', chr(39) + 'mm' + chr(39), chr(39) + 'mm/s' + chr(39), chr(39) + ' mm' + chr(39))}", "100", "200", "300", "30"),
    (5, f"'净重 ' || {_Q} || {_pick('p', *[chr(39) + u + chr(39) for u in ('Kg', 'kg', 'KG', 'MPA', 'Mpa', 'Kgf')])}", "100", "240", "300", "30"),
    (6, f"'面积 ' || {_Q} || {_pick('s', *[chr(39) + u + chr(39) for u in ('m2', 'm²', 'm23', '㎡')])}", "100", "280", "300", "30"),
    (7, _pick("p", "'重量三十公斤'", f"'重量' || {_Q} || 'kg'", "'约二 米'"), "100", "320", "300", "30"),
    (8, _pick("n", f"'第' || {_S('n')} || '页共' || {_S('total')} || '页'", f"'共' || {_S('total')} || '页 第' || {_S('n')} || '页'", f"'第' || {_S('n')} || '页'", f"{_S('n')} || '/' || {_S('total')} || '页'"), "400 + q * 8", "1330 - p % 4 * 60", "200", "30"),
    (9, f"'称重 ' || {_pick('p', chr(39) * 2, chr(39) + 'PN' + chr(39), chr(39) * 2)} || {_Q} || '.' || substr('123456', 1, s % 6 + 1)", "100", "400", "300", "30"),
    (10, f"{_Q} || '(-0.' || {_S('n')} || '~+0.' || {_S('CASE WHEN p % 3 = 0 THEN n ELSE n + 1 END')} || ')'", "100", "440", "300", "30"),
    (11, _pick("p", "'特殊记载：无'", "'特殊记载'", "'备注'", "'特殊记载 见附页'"), "100 + q * 10", "480", "150", "30"),
    (12, _pick("s", "'此件与原件一致'", "'复印件与原件一致'", "'与原件 相符'", "'正常'"), "300 + q * 10", "700 + p % 300", "200", "30"),
)
TABLE_LINES = (
    (1, "'实际'", "600", "300", "80", "30"),
    (2, "'规定'", "400", "300", "80", "30"),
    (3, f"{_Q} || '.' || substr('2500', 1, s % 3 + 1) || '±0.1'", "390", "400", "90", "30"),
    (4, _pick("p", "'合格'", f"{_Q} || '.3'", f"{_Q} || '.35'", f"'R' || {_Q} || '.02～R' || {_Q} || '.06'"), "600", "400 + p % 7 * 8", "90", "30"),
    (5, _pick("n", "'R5(2处)'", "'测量7点'", "'压力'"), "100", "500", "90", "30"),
    (6, _pick("s", "'3.1'", "'3.1MPa'", "'合格'", "'5.02～5.06'"), "610", "500 + p % 5 * 8", "60", "30"),
    (7, _pick("p", "'复核人'", "'复核人：张'", "'审核人'"), "100", "1200", "120", "30"),
    (8, _pick("s", "'李四'", "'：'", "'王五'"), "300", "1200 + n * 10", "80", "30"),
    (9, _pick("s", "'此件与原件一致'", "'正常'"), "500", "1100", "200", "30"),
    (10, _pick("n", "'检验员'", "'质检'", "'操作者'"), "800", "300", "90", "30"),
)
NOTE_LINES = (
    (1, _pick("p", "'呈报单 见附件'", "'正常'", "'超差 同意使用'", "'不合格 1件'"), "100", "200", "200", "30"),
    (2, _pick("s", "'共3页'", "'已闭环'", "'拒收单 12'", "'设计图版次：A'", "'无'"), "100", "240", "200", "30"),
    (3, _pick("n", "'36HRC'", "'36～38HRC'", "'零件号 批次'"), "100", "280", "200", "30"),
    (4, _pick("q", "'抽检 3'", "'抽检'", "'全检'"), "100", "320", "200", "30"),
    (5, _pick("p", "'配套 12'", "'22-02-1-2'", "'不涉及呈报'", "'其他'", "'序号 3'"), "100", "1000 + s % 3", "200", "30"),
)
#: (number, content, x, y, w, h, ink)
CELLS = (
    (1, "'装配处'", "100", "600", "80", "40", "0.05"),
    (2, _pick("p", "'/'", "'／'", "'A12'", "''"), "190 + s % 10", "600 + n", "80", "40", "0.01"),
    (3, "'零件号'", "100", "650", "80", "40", "0.05"),
    (4, _pick("s", "''", "'PN-2832'"), "190", "650", "80", "40", "CAST(p % 10 AS DOUBLE) / 1000"),
    (5, "'检验结论'", "100", "700", "80", "40", "0.05"),
    (6, _pick("n", "''", "'合格'"), "190", "700", "80", "40", "CAST(s % 10 AS DOUBLE) / 1000"),
    (7, "''", "600", "330", "100", "500", "0.02"),
    (8, "''", "590", "290", "100", "45", "0.02"),
    (9, "'入库箱数'", "100", "800", "80", "40", "0.05"),
    (10, _pick("p", "''", "'12'", "' '"), "190", "800 + n * 4", "80", "40", "0.01"),
)
#: (number, x, y, w, h, angle, area, fill, rectangularity)
SEALS = (
    (1, "100 + p % 60 * 10", "70 + s % 50", "120", "60", "CAST(p % 41 AS DOUBLE) - 20", "2000 + p % 1000", "CAST(p % 100 AS DOUBLE) / 100", "CAST(60 + s % 40 AS DOUBLE) / 100"),
    (2, "100 + p % 60 * 10 + s % 70", "90 + q", "60", "60", "CAST(s % 31 AS DOUBLE) - 15", "800 + p % 1500", "CAST(20 + s % 80 AS DOUBLE) / 100", "CAST(50 + p % 50 AS DOUBLE) / 100"),
    (3, "800 + q - p % 2 * 500", "340 + p % 300", "50", "50", "0.0", "1500", "0.5", "0.9"),
)
#: (number, x, y, w, h)
SEGMENTS = (
    (1, "100 + q", "92", "160", "3"),
    (2, "110", "130 + n", "140 + q", "3"),
    (3, "120", "170 + s % 9", "170", "3"),
    (4, "100", "210 + n % 5", "200", "4"),
    (5, "120", "255", "130 + q", "3"),
)

_FIELDS = {
    "lines": ("line_no", "text", "x", "y", "w", "h", "red_ratio"),
    "rows": ("line_no", "text", "x", "y", "w", "h"),
    "notes": ("line_no", "text", "x", "y", "w", "h"),
    "cells": ("cell_no", "content", "x", "y", "w", "h", "ink"),
    "seals": ("seal_no", "x", "y", "w", "h", "angle", "area", "fill", "rect"),
    "segments": ("seg_no", "x", "y", "w", "h"),
}
#: Dates are printed in red on some pages.
_RED = [(*line, "CAST(q % 4 AS DOUBLE) / 100" if line[0] == 1 else "0.0") for line in TEXT_LINES]
_PARTS = {"lines": _RED, "rows": TABLE_LINES, "notes": NOTE_LINES, "cells": CELLS, "seals": SEALS, "segments": SEGMENTS}
_DOUBLE = ("ink", "angle", "fill", "rect", "red_ratio")
_KEYS = "doc_id, page_no, page_count, form_type, width, height, marker, total, red_ratio, blue_ratio, column_red, row_red"


def _value(field: str, expression: object) -> str:
    if field in ("text", "content"):
        return str(expression)
    return f"CAST({expression} AS {'DOUBLE' if field in _DOUBLE else 'INT'})"


def pages(spark: SparkSession, sf_dir: str, *parts: str, apart: bool = False) -> DataFrame:
    """One row a page: keys, page measures and, for each of parts, an array of its lines, rows, cells, seals or segments.

    apart: the arrays are built outside whole-stage code, which a lambda beside them does; its one method would be longer than the 8,000 bytes that the JIT compiles if they are read whole."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("folioscope_lineitem")
    base = spark.sql(PAGE.replace("FROM lineitem", "FROM folioscope_lineitem"))
    columns = [F.col(c.strip()) for c in _KEYS.split(",")]
    if apart:
        columns[1] = F.expr("transform(array(page_no), n -> n)[0]").alias("page_no")
    for part in parts:
        entries = [f"named_struct({', '.join(f'{chr(39)}{f}{chr(39)}, {_value(f, v)}' for f, v in zip(_FIELDS[part], e, strict=True))})" for e in _PARTS[part]]
        columns.append(F.expr(f"array({', '.join(entries)})").alias(part))
    return base.select(*columns)


def nested(page: DataFrame, **parts: DataFrame) -> DataFrame:
    """The same nested rows from normalised tables keyed (doc_id, page_no): one shuffle a table, pages bound the arrays."""
    out = page
    for name, rows in parts.items():
        fields = [c for c in rows.columns if c not in ("doc_id", "page_no")]
        grouped = rows.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        empty = F.array().cast(grouped.schema[name].dataType)
        out = out.join(grouped, ["doc_id", "page_no"], "left").withColumn(name, F.coalesce(name, empty))
    return out


def sql_with(*parts: str) -> str:
    """WITH clause of the SQL twins: page and, unnested, each of parts (text lines as `lines`, table lines as `rows`)."""
    out = [f"page AS ({PAGE})"]
    for part in parts:
        entries = ", ".join("{" + ", ".join(f"'{f}': {_value(f, v)}" for f, v in zip(_FIELDS[part], e, strict=True)) + "}" for e in _PARTS[part])
        name = {"rows": "trows", "lines": "tlines", "notes": "tnotes"}.get(part, part)
        fields = ", ".join(f"e.{f} AS {'line_red' if f == 'red_ratio' else f}" for f in _FIELDS[part])
        out.append(f"{name} AS (SELECT {_KEYS}, {fields} FROM (SELECT {_KEYS}, unnest([{entries}]) AS e FROM page))")
    return "WITH " + ",\n".join(out)


#: Findings of three runs: suppliers are archives, seq is the order of insertion within an archive.
FINDING = """
SELECT 'run' || CAST(CAST(l_quantity AS INT) % 3 AS STRING) AS run_id, CAST(l_suppkey AS STRING) AS doc_id, CAST(l_partkey % 40 AS INT) + 1 AS page_no,
  'A' || lpad(CAST(l_linenumber AS STRING), 2, '0') AS rule_id, CASE l_linenumber % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'ODD' END AS level,
  'm' || CAST(l_partkey % 3 AS STRING) AS message, CAST(l_partkey % 4 AS INT) AS x,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_shipdate, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS INT) AS seq
FROM lineitem
"""
#: Verdicts on some findings, by finding key; deciders come back later, so that a key can have several.
KEYED = f"SELECT *, run_id || '|' || doc_id || '|' || CAST(page_no AS STRING) || '|' || rule_id || '|' || CAST(row_number() OVER (PARTITION BY run_id, doc_id, page_no, rule_id ORDER BY seq) AS STRING) AS finding_key FROM ({FINDING}) f"
VERDICT = f"SELECT finding_key, CASE seq % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unsure' END AS verdict, 'u' || CAST(seq % 5 AS STRING) AS reviewer, CAST(2024 + seq % 2 AS STRING) || '.01.' || lpad(CAST(seq % 28 + 1 AS STRING), 2, '0') AS decided_at FROM ({KEYED}) k WHERE seq % 4 <> 0"


def relation(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """SQL over driver tables; each name in tables is read from sf_dir."""
    for name in tables or ("lineitem",):
        table(spark, sf_dir, name).createOrReplaceTempView(f"folioscope_{name}")
        sql = sql.replace(f"FROM {name}", f"FROM folioscope_{name}").replace(f"JOIN {name}", f"JOIN folioscope_{name}")
    return spark.sql(sql)
