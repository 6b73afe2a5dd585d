"""Small functions over derived pages and driver tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import text as t
from ..operators import page_rules
from ..sources import derived
from ..sources.tables import table
from .page_queries import pages_for

_CX, _CY = "(x + w / 2.0)", "(y + h / 2.0)"
_SHARED = "least(a.x + a.w, k.x + k.w) - greatest(a.x, k.x)"


def jn_header_above(spark, d):
    found = f"filter(transform(cells, a -> named_struct('cell_no', a.cell_no, 'header_no', {page_rules.above('a')}.cell_no)), o -> o.header_no IS NOT NULL)"
    return derived.pages(spark, d, "cells").select("doc_id", "page_no", F.explode(F.expr(found)).alias("o")).select("doc_id", "page_no", "o.*")


def fn_line_geometry(spark, d):
    e = pages_for(spark, d, "rows").select("doc_id", "page_no", F.explode("lines").alias("l"))
    return e.selectExpr("doc_id", "page_no", "l.line_no", f"{g.cx('l')} AS cx", f"{g.cy('l')} AS cy", f"{g.right('l')} AS x2", f"{g.bottom('l')} AS y2")


def fn_cell_content(spark, d):
    held = f"transform(lines, l -> named_struct('cx', {g.cx('l')}, 'line_no', l.line_no, 'text', l.text, 'cell_no', {g.owner('cells', g.cx('l'), g.cy('l'))}.cell_no))"
    own = "trim(array_join(transform(array_sort(filter(held, o -> o.cell_no = k.cell_no)), o -> o.text), ''))"
    p = pages_for(spark, d, "rows", "cells").withColumn("held", F.expr(held))
    filled = f"transform(filter(cells, k -> exists(held, o -> o.cell_no = k.cell_no)), k -> named_struct('cell_no', k.cell_no, 'content', {own}))"
    return p.select("doc_id", "page_no", F.explode(F.expr(filled)).alias("c")).select("doc_id", "page_no", "c.*")


def fn_blank_pages(spark, d):
    return pages_for(spark, d, "notes").selectExpr("doc_id", "page_no", f"{page_rules.BLANK} AS blank", f"{page_rules.COPY} AS copy")


def fn_safe_name(spark, d):
    named = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("（"), "c_mktsegment", F.lit("）")).alias("n"))
    return named.selectExpr("c_custkey", f"{t.safe_name('n')} AS name")


def fn_escape(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{t.escaped('html')} AS shown")


def fn_density(spark, d):
    n = derived.relation(spark, d, derived.FINDING).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_no").alias("pages"))
    top = n.orderBy(F.desc("n"), "doc_id").limit(10)
    most = F.max("n").over(Window.partitionBy(F.lit(1)))  # ten rows
    return top.select("doc_id", F.when(F.col("pages") > 0, F.round(F.col("n") / F.col("pages"), 2)).alias("density"), F.round(100.0 * F.col("n") / most, 1).alias("bar"))


QUERIES = {f.__name__: f for f in (jn_header_above, fn_line_geometry, fn_cell_content, fn_blank_pages, fn_safe_name, fn_escape, fn_density)}
QUERIES["fn_escape_whole"] = fn_escape  # its former name
SQL = {
    "jn_header_above": f"""{derived.sql_with("cells")} SELECT a.doc_id, a.page_no, a.cell_no, k.cell_no AS header_no FROM cells a JOIN cells k ON a.doc_id = k.doc_id AND a.page_no = k.page_no
      AND k.y + k.h <= a.y AND k.content <> '' AND {_SHARED} > 0 AND {_SHARED} >= 0.6 * least(a.w, k.w) QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.cell_no ORDER BY a.y - (k.y + k.h), k.cell_no) = 1""",
    "fn_line_geometry": f"{derived.sql_with('rows')} SELECT doc_id, page_no, line_no, {_CX} AS cx, {_CY} AS cy, x + w AS x2, y + h AS y2 FROM trows",
    "fn_cell_content": f"""{derived.sql_with("rows", "cells")}, o AS (SELECT l.doc_id, l.page_no, l.text, l.x + l.w / 2.0 AS cx, l.line_no, k.cell_no FROM trows l JOIN cells k ON k.doc_id = l.doc_id AND k.page_no = l.page_no
      AND l.x + l.w / 2.0 BETWEEN k.x AND k.x + k.w AND l.y + l.h / 2.0 BETWEEN k.y AND k.y + k.h QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.page_no, l.line_no ORDER BY k.w * k.h, k.cell_no) = 1)
      SELECT doc_id, page_no, cell_no, trim(string_agg(text, '' ORDER BY cx, line_no)) AS content FROM o GROUP BY ALL""",
    "fn_blank_pages": f"{derived.sql_with('notes')} SELECT doc_id, page_no, count(*) < 3 AS blank, bool_or(contains(replace(text, ' ', ''), '与原件')) AS copy FROM tnotes GROUP BY ALL",
    "fn_safe_name": "SELECT c_custkey, left(regexp_replace(c_name || '（' || c_mktsegment || '）', '[^A-Za-z0-9_-]+', '_', 'g'), 32) || '_' || left(sha1(c_name || '（' || c_mktsegment || '）'), 6) AS name FROM customer",
    "fn_escape": """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS shown FROM pages""",
    "fn_density": f"""SELECT doc_id, CASE WHEN pages > 0 THEN round(n / pages, 2) END AS density, round(100.0 * n / max(n) OVER (), 1) AS bar
      FROM (SELECT doc_id, count(*) AS n, count(DISTINCT page_no) AS pages FROM ({derived.FINDING}) f GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 10) z""",
}
SQL["fn_escape_whole"] = SQL["fn_escape"]
