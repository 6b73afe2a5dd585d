"""Segmentation and unit rules, text and geometry functions, linear models, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import text as t
from ..operators import classify, findings, image, model, page_rules, segment
from ..sources import derived
from ..sources.tables import table
from . import catalog as c
from .page_queries import _CELL_SHARE_Y, _column, _labelled, pages_for
from .store_queries import _PAGES

Q, S = {}, {}


def _add(name: str, sql: str | None):
    def keep(fn):
        Q[name] = fn
        if sql:
            S[name] = sql
        return fn

    return keep


_DIGEST = f"""SELECT doc_id, page_no, form_type, CASE WHEN n % 4 = 0 THEN NULL ELSE CAST(s % 3 AS STRING) END AS part, marker, total, q % 7 = 0 AS has_title, 50 + p % 40 AS text_len,
  CASE WHEN p % 3 = 0 THEN '' ELSE 'f' || CAST(q % 5 AS STRING) END AS fingerprint FROM ({derived.PAGE}) pg"""


def digests(spark, d):
    df = derived.relation(spark, d, _DIGEST)
    marker = F.when(F.col("marker").isNotNull(), F.struct(F.col("marker").alias("current"), F.col("total")))
    keys = F.when(F.col("part").isNull(), F.expr("CAST(map() AS map<string,string>)")).otherwise(F.create_map(F.lit("零件号"), F.col("part")))
    return df.select("doc_id", "page_no", "form_type", keys.alias("keys"), marker.alias("marker"), "has_title", "text_len", "fingerprint")


_SEG = f"""WITH RECURSIVE dg AS MATERIALIZED ({_DIGEST}), st AS (
  SELECT doc_id, page_no, 1 AS unit, form_type AS form, part AS k, marker AS lc, CASE WHEN marker IS NOT NULL THEN total END AS lt, CASE WHEN marker = 1 THEN total END AS declared, marker IS NOT NULL AS marked, 1 AS n FROM dg WHERE page_no = 1
  UNION ALL
  SELECT doc_id, page_no, unit + nw, CASE WHEN nw = 1 THEN form_type ELSE form END, CASE WHEN nw = 1 THEN part ELSE coalesce(k, part) END,
    CASE WHEN nw = 1 THEN marker ELSE coalesce(marker, lc) END, CASE WHEN marker IS NOT NULL THEN total WHEN nw = 1 THEN NULL ELSE lt END,
    CASE WHEN marker IS NULL THEN CASE WHEN nw = 1 THEN NULL ELSE declared END WHEN nw = 1 OR NOT marked THEN CASE WHEN marker = 1 THEN total END ELSE declared END,
    (nw = 0 AND marked) OR marker IS NOT NULL, CASE WHEN nw = 1 THEN 1 ELSE n + 1 END
  FROM (SELECT d.doc_id, d.page_no, d.form_type, d.part, d.marker, d.total, s.unit, s.form, s.k, s.lc, s.lt, s.declared, s.marked, s.n,
    CASE WHEN s.k <> d.part THEN 1 WHEN d.marker = 1 THEN 1 WHEN d.marker = s.lc + 1 AND d.total = s.lt THEN 0 WHEN coalesce(s.declared, 0) > 0 AND s.n >= s.declared THEN 1 WHEN d.form_type <> s.form THEN 1 WHEN d.has_title AND d.part IS NOT NULL THEN 1 ELSE 0 END AS nw
    FROM st s JOIN dg d ON d.doc_id = s.doc_id AND d.page_no = s.page_no + 1) z
), parts AS (
  SELECT doc_id, unit, arg_min(form, page_no) AS form, arg_max(k, page_no) AS k, list(page_no ORDER BY page_no) AS pages, arg_max(declared, page_no) AS declared FROM st GROUP BY ALL
), marks AS (SELECT st.doc_id, st.unit, st.page_no, dg.marker, dg.total FROM st JOIN dg USING (doc_id, page_no) WHERE dg.marker IS NOT NULL
), un AS (
  SELECT doc_id, min(unit) AS unit, arg_min(form, unit) AS form, list_sort(flatten(list(pages))) AS pages, arg_min(declared, unit) FILTER (WHERE declared IS NOT NULL) AS declared, list(unit) AS parts
  FROM parts GROUP BY doc_id, CASE WHEN k IS NULL THEN '#' || unit ELSE form || '|' || k END
), um AS (SELECT u.doc_id, u.unit, list(m.marker ORDER BY m.unit, m.page_no) AS seq, list(m.page_no) AS at FROM un u JOIN marks m ON m.doc_id = u.doc_id AND list_contains(u.parts, m.unit) GROUP BY ALL
), full_u AS (SELECT u.doc_id, u.doc_id || '#U' || lpad(CAST(u.unit AS VARCHAR), CAST(greatest(3, length(CAST(u.unit AS VARCHAR))) AS INT), '0') AS unit_id, u.unit, u.form AS form_type, u.pages, len(u.pages) AS page_count, u.declared, coalesce(m.seq, []) AS seq, coalesce(m.at, []) AS at_pages FROM un u LEFT JOIN um m USING (doc_id, unit))"""
_SHORT = "coalesce(declared, 0) > 0 AND page_count < declared"


@_add("wn_segment", f"{_SEG} SELECT doc_id, page_no, unit AS unit_no FROM st")
def _(spark, d):
    return segment.page_units(digests(spark, d)).select("doc_id", "page_no", "unit_no")


@_add("wn_segment_long", f"{_SEG} SELECT doc_id, page_no, unit AS unit_no FROM st")
def _(spark, d):
    return segment.segment_long(digests(spark, d))


def _units(spark, d):
    return segment.units(segment.page_units(digests(spark, d)))


@_add("wn_units", f"{_SEG} SELECT unit_id, form_type, array_to_string(pages, ',') AS pages, CAST(page_count AS INT) AS page_count, declared AS declared_total, CAST(len(seq) AS INT) AS markers FROM full_u")
def _(spark, d):
    return _units(spark, d).select("unit_id", "form_type", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "page_count", "declared_total", F.size("markers").alias("markers"))


def _gate(rule: str) -> str:
    return c.BOOK[rule].applies()


_U = "SELECT doc_id, unit_id, '{r}' AS rule_id, CAST({page} AS INT) AS page_no, CAST({detail} AS VARCHAR) AS detail, CAST({conf} AS DOUBLE) AS confidence FROM {frm} WHERE ({where}) AND {gate}"


@_add("u01_missing_pages", _SEG + _U.format(r="U01", page="pages[1]", detail="declared - page_count", conf="0.7", frm="full_u", where=_SHORT, gate=_gate("U01")))
def _(spark, d):
    return segment.missing_pages(_units(spark, d))


@_add("u01_missing_head", _SEG + _U.format(r="U01", page="pages[1]", detail=f"CASE WHEN {_SHORT} THEN declared - page_count ELSE seq[1] - 1 END", conf=f"CASE WHEN {_SHORT} THEN 0.7 ELSE 0.45 END", frm="full_u", where=f"({_SHORT}) OR seq[1] > 1", gate=_gate("U01")))
def _(spark, d):
    return segment.missing_pages(_units(spark, d), flag_head=True)


_DUP = "list_sort(list_distinct(list_filter(seq, lambda x: len(list_filter(seq, lambda y: y = x)) > 1)))"
_GAP = """list_filter([CASE WHEN list_sort(seq)[i + 1] - list_sort(seq)[i] = 2 THEN CAST(list_sort(seq)[i] + 1 AS VARCHAR) WHEN list_sort(seq)[i + 1] - list_sort(seq)[i] > 2 THEN (list_sort(seq)[i] + 1) || '-' || (list_sort(seq)[i + 1] - 1) END FOR i IN range(1, len(seq))], lambda g: g IS NOT NULL)"""


@_add("u02_page_sequence", _SEG + _U.format(r="U02", page="pages[1]", detail="CASE WHEN len(dup) > 0 THEN 'repeats ' || array_to_string(dup, ',') ELSE 'lacks ' || array_to_string(gap, ',') END", conf="0.6", frm=f"(SELECT *, {_DUP} AS dup, {_GAP} AS gap FROM full_u WHERE len(seq) >= 2) z", where="len(dup) > 0 OR len(gap) > 0", gate=_gate("U02")))
def _(spark, d):
    return segment.page_sequence(_units(spark, d))


@_add("u03_unnumbered", _SEG + _U.format(r="U03", page="bare[1]", detail="len(bare) || ': ' || array_to_string(list_slice(bare, 1, 6), ',')", conf="0.55", frm="(SELECT *, list_filter(pages, lambda p: NOT list_contains(at_pages, p)) AS bare FROM full_u) z", where="page_count >= 2 AND len(list_distinct(seq)) < page_count AND len(bare) > 0", gate=_gate("U03")))
def _(spark, d):
    return segment.unnumbered_pages(_units(spark, d))


@_add("u04_repeated_record", _SEG + _U.format(r="U04", page="copies[1]", detail="array_to_string(copies, ',')", conf="0.6", frm="(SELECT s.doc_id, s.copies, u.unit_id, u.form_type FROM (SELECT doc_id, fingerprint, list(page_no ORDER BY page_no) AS copies FROM dg WHERE fingerprint <> '' AND text_len >= 60 GROUP BY ALL HAVING count(*) > 1) s JOIN full_u u ON u.doc_id = s.doc_id AND list_contains(u.pages, s.copies[1])) z", where="true", gate=_gate("U04")))
def _(spark, d):
    return segment.repeated_records(_units(spark, d))


@_add("ag_declared_mismatch", f"{_SEG} SELECT unit_id, declared AS declared_total, CAST(page_count AS INT) AS page_count FROM full_u WHERE declared IS NOT NULL AND declared <> page_count")
def _(spark, d):
    return _units(spark, d).where("declared_total IS NOT NULL AND declared_total <> page_count").select("unit_id", "declared_total", "page_count")


@_add("ag_unit_findings", f"{_SEG}, fd AS (SELECT CAST(l_orderkey AS STRING) AS doc_id, l_linenumber AS page_no FROM lineitem) SELECT unit_id, count(fd.page_no) AS findings FROM (SELECT unit_id, doc_id, unnest(pages) AS page_no FROM full_u) u LEFT JOIN fd USING (doc_id, page_no) GROUP BY unit_id")
def _(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.lit(1).alias("one"))
    placed = _units(spark, d).select("unit_id", "doc_id", F.explode("pages").alias("page_no"))
    return placed.join(found, ["doc_id", "page_no"], "left").groupBy("unit_id").agg(F.count("one").alias("findings"))


@_add("so_units", f"{_SEG} SELECT unit_id, form_type, pages[1] AS start_page, pages[len(pages)] AS end_page FROM full_u")
def _(spark, d):
    return segment.listed(_units(spark, d)).select("unit_id", "form_type", "start_page", "end_page")


Q["so_run_units"], S["so_run_units"] = Q["so_units"], S["so_units"]  # its former name


@_add("jn_archive_overview", f"{_SEG}, p AS (SELECT doc_id, count(*) AS pages FROM ({_PAGES}) z GROUP BY 1), x AS (SELECT doc_id, count(*) AS findings, count(*) FILTER (WHERE level = 'CRITICAL') AS critical, count(*) FILTER (WHERE level = 'HIGH') AS high, count(*) FILTER (WHERE level = 'MEDIUM') AS medium, count(*) FILTER (WHERE level = 'LOW') AS low FROM ({derived.FINDING}) z GROUP BY 1), n AS (SELECT doc_id, count(*) AS units FROM full_u GROUP BY 1) SELECT coalesce(p.doc_id, x.doc_id) AS doc_id, coalesce(pages, 0) AS pages, coalesce(units, 0) AS units, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM p FULL JOIN x ON p.doc_id = x.doc_id LEFT JOIN n ON n.doc_id = coalesce(p.doc_id, x.doc_id)")
def jn_archive_overview(spark, d):
    return findings.archive_overview(derived.relation(spark, d, _PAGES), _units(spark, d), derived.relation(spark, d, derived.FINDING))


Q["jn_doc_union"], S["jn_doc_union"] = Q["jn_archive_overview"], S["jn_archive_overview"]  # its former name


@_add("fn_unit_label", f"{_SEG} SELECT unit_id, form_type || '（p' || pages[1] || '-' || pages[len(pages)] || '）' AS label FROM full_u")
def _(spark, d):
    return _units(spark, d).select("unit_id", F.concat("form_type", F.lit("（p"), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"), F.lit("）")).alias("label"))


_CX, _CY = "(x + w / 2.0)", "(y + h / 2.0)"


@_add("fn_page_text", f"{derived.sql_with('notes')} SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY floor({_CY} / 20), {_CX}, line_no) AS page_text FROM tnotes GROUP BY ALL")
def _(spark, d):
    return page_rules.prepared(pages_for(spark, d, "notes")).select("doc_id", "page_no", "page_text")


@_add("fn_marker", f"{derived.sql_with('lines')}, m AS (SELECT doc_id, page_no, line_no, CASE WHEN regexp_matches(text, '第 *[0-9]+ *页') AND regexp_matches(text, '共 *[0-9]+ *页') THEN regexp_extract(text, '第 *([0-9]+) *页', 1) || '/' || regexp_extract(text, '共 *([0-9]+) *页', 1) WHEN CAST(nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{{1,3}})/([0-9]{{1,3}})页', 1), '') AS INT) BETWEEN 1 AND CAST(nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{{1,3}})/([0-9]{{1,3}})页', 2), '') AS INT) THEN regexp_extract(text, '(?:^|[^0-9])([0-9]{{1,3}}/[0-9]{{1,3}})页', 1) END AS v FROM tlines) SELECT doc_id, page_no, CAST(split_part(arg_min(v, line_no), '/', 1) AS INT) AS current, CAST(split_part(arg_min(v, line_no), '/', 2) AS INT) AS total FROM m WHERE v IS NOT NULL GROUP BY ALL")
def _(spark, d):
    pages = page_rules.prepared(pages_for(spark, d, "lines")).select("doc_id", "page_no", "lines", "page_text")
    return classify.known(pages, classify.marker("lines", "page_text"), "m").select("doc_id", "page_no", "m.current", "m.total")


@_add("fn_keys", f"{derived.sql_with('cells')} SELECT doc_id, page_no, substr(regexp_replace(content, '\\s+', '', 'g'), 1, 30) AS value FROM {_labelled('零件号')} WHERE trim(coalesce(content, '')) <> ''")
def _(spark, d):
    pages = derived.pages(spark, d, "cells").withColumn("lines", F.expr("CAST(array() AS array<struct<line_no:int,text:string,x:int,y:int,w:int,h:int>>)")).withColumn("page_text", F.lit(""))
    return classify.known(pages, f"try_element_at({classify.keys()}, '零件号')", "value").select("doc_id", "page_no", "value")


@_add("fn_fingerprint", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[\\s\\x{85}\\x{A0}]+', '', 'g')) < 20 THEN '' ELSE left(sha1(regexp_replace(text, '[\\s\\x{85}\\x{A0}]+', '', 'g')), 16) END AS fingerprint FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(t.fingerprint("text")).alias("fingerprint"))


@_add("u04_document_copies", "SELECT source, fp, count(*) AS copies, min(doc_id) AS first FROM (SELECT source, doc_id, left(sha1(regexp_replace(text, '\\s+', '', 'g')), 16) AS fp FROM documents WHERE length(regexp_replace(text, '\\s+', '', 'g')) >= 60) z GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    fp = table(spark, d, "documents").select("source", "doc_id", F.expr(t.fingerprint("text")).alias("fp"), F.expr(f"length(regexp_replace(text, {t.pattern(chr(92) + 's+')}, ''))").alias("n")).where("n >= 60")
    return fp.groupBy("source", "fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@_add("fn_classify", f"{derived.sql_with('notes')}, jt AS (SELECT doc_id, page_no, coalesce(string_agg(text, '' ORDER BY line_no) FILTER (WHERE {_CY} < height * 0.34), '') AS head, string_agg(text, '' ORDER BY line_no) AS body FROM tnotes GROUP BY ALL), hd AS (SELECT doc_id, page_no, contains(head, '合格证') AS h1, contains(head, '呈报') AS h2, contains(body, '合格证') AS a1, contains(body, '呈报') AS a2, contains(body, '零件号') AND contains(body, '抽检') AS st FROM jt) SELECT doc_id, page_no, CASE WHEN h1 THEN '产品合格证' WHEN h2 THEN '呈报单' WHEN a1 THEN '产品合格证' WHEN a2 THEN '呈报单' WHEN st THEN '检验记录' ELSE '未识别' END AS form FROM hd")
def _(spark, d):
    forms = classify.Forms(patterns=(("产品合格证", ("合格证",)), ("呈报单", ("呈报",))), structural=(("检验记录", ("零件号", "抽检")),))
    return pages_for(spark, d, "notes").select("doc_id", "page_no", F.expr(forms.sql()).alias("form"))


_P2 = f"{derived.sql_with('seals')} SELECT a.doc_id, a.page_no, round(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / CAST(a.w * a.h + b.w * b.h - greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS DOUBLE), 4) AS iou FROM seals a JOIN seals b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.seal_no = 1 AND b.seal_no = 2"


@_add("fn_iou", _P2)
def _(spark, d):
    return derived.pages(spark, d, "seals").selectExpr("doc_id", "page_no", "seals[0] AS a", "seals[1] AS b").selectExpr("doc_id", "page_no", f"round({g.iou('a', 'b')}, 4) AS iou")


@_add("img_normal_angle", f"{derived.sql_with('seals')} SELECT doc_id, page_no, seal_no, CASE WHEN v > 45 THEN v - 90 ELSE v END AS angle FROM (SELECT *, ((angle * 7 % 90) + 90) % 90 AS v FROM seals) z")
def _(spark, d):
    s = derived.pages(spark, d, "seals").select("doc_id", "page_no", F.explode("seals").alias("s"))
    return s.selectExpr("doc_id", "page_no", "s.seal_no", f"{g.normal_angle('(s.angle * 7)')} AS angle")


_HOLDS = "k.fill >= 0.18 AND greatest(least(k.x + k.w, s[1].x + s[1].w) - greatest(k.x, s[1].x), 0) * greatest(least(k.y + k.h, s[1].y + s[1].h) - greatest(k.y, s[1].y), 0) / CAST(greatest(1, s[1].w * s[1].h) AS DOUBLE) >= 0.9"
_GROWN = """{'x': least(k.x, s[1].x), 'y': least(k.y, s[1].y), 'w': greatest(k.x + k.w, s[1].x + s[1].w) - least(k.x, s[1].x), 'h': greatest(k.y + k.h, s[1].y + s[1].h) - least(k.y, s[1].y)}"""
_MERGED = f"""{derived.sql_with('seals')}, boxed AS (SELECT doc_id, page_no, list({{'seal_no': seal_no, 'x': x, 'y': y, 'w': w, 'h': h, 'area': area, 'fill': fill}} ORDER BY area DESC, seal_no) AS l FROM seals GROUP BY ALL),
  folded AS (SELECT doc_id, page_no, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda kept, s: CASE WHEN coalesce(list_position(list_transform(kept, lambda k: {_HOLDS}), true), 0) = 0 THEN list_concat(kept, s)
    ELSE list_transform(kept, lambda k, i: CASE WHEN i <> list_position(list_transform(kept, lambda k: {_HOLDS}), true) THEN k ELSE {{'seal_no': k.seal_no, 'x': {_GROWN}.x, 'y': {_GROWN}.y, 'w': {_GROWN}.w, 'h': {_GROWN}.h, 'area': {_GROWN}.w * {_GROWN}.h,
      'fill': least(1.0, (k.fill * k.area + s[1].fill * s[1].area) / greatest(1, {_GROWN}.w * {_GROWN}.h))}} END) END)) AS s FROM boxed)
  SELECT doc_id, page_no, s.seal_no AS seal_no, s.x AS x, s.y AS y, s.w AS w, s.h AS h, round(s.fill, 6) AS fill FROM folded"""


@_add("img_merge_nested", _MERGED)
def _(spark, d):
    s = image.with_merged_seals(derived.pages(spark, d, "seals")).select("doc_id", "page_no", F.explode("seals").alias("s"))
    return s.selectExpr("doc_id", "page_no", "s.seal_no", "s.x", "s.y", "s.w", "s.h", "round(s.fill, 6) AS fill")


@_add("jn_text_to_cell", f"{derived.sql_with('rows', 'cells')} SELECT l.doc_id, l.page_no, l.line_no, k.cell_no FROM trows l LEFT JOIN cells k ON k.doc_id = l.doc_id AND k.page_no = l.page_no AND l.x + l.w / 2.0 BETWEEN k.x AND k.x + k.w AND l.y + l.h / 2.0 BETWEEN k.y AND k.y + k.h QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.page_no, l.line_no ORDER BY k.w * k.h, k.cell_no) = 1")
def _(spark, d):
    owned = f"transform(lines, l -> named_struct('line_no', l.line_no, 'cell_no', {g.owner('cells', g.cx('l'), g.cy('l'))}.cell_no))"
    return pages_for(spark, d, "rows", "cells").select("doc_id", "page_no", F.explode(F.expr(owned)).alias("o")).select("doc_id", "page_no", "o.*")


@_add("jn_column_range", f"{derived.sql_with('rows', 'cells')} SELECT doc_id, page_no, hdr_no, x1, x2 FROM {_column(c.ACTUAL_HEADERS)} z")
def _(spark, d):
    p = page_rules.prepared(pages_for(spark, d, "rows", "cells")).where("actual_column IS NOT NULL")
    return p.selectExpr("doc_id", "page_no", "actual_column.hdr.line_no AS hdr_no", "actual_column.x1 AS x1", "actual_column.x2 AS x2")


@_add("jn_label_value", f"{derived.sql_with('cells')} SELECT doc_id, page_no, a_no, v_no, content FROM {_labelled('装配处')}")
def _(spark, d):
    p = derived.pages(spark, d, "cells").withColumn("a", F.expr(page_rules.label_cell("'装配处'"))).where("a IS NOT NULL").withColumn("v", F.expr(page_rules.value_cell("a")))
    return p.selectExpr("doc_id", "page_no", "a.cell_no AS a_no", "v.cell_no AS v_no", "v.content AS content")


@_add("jn_row_label", f"{derived.sql_with('cells')} SELECT a.doc_id, a.page_no, a.cell_no, k.cell_no AS label_no FROM cells a JOIN cells k ON a.doc_id = k.doc_id AND a.page_no = k.page_no AND k.x + k.w <= a.x AND k.content <> '' AND {_CELL_SHARE_Y} > 0 AND {_CELL_SHARE_Y} >= 0.5 * least(a.h, k.h) QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.cell_no ORDER BY a.x - (k.x + k.w), k.cell_no) = 1")
def _(spark, d):
    p = derived.pages(spark, d, "cells").select("doc_id", "page_no", F.explode(F.expr(f"filter(transform(cells, a -> named_struct('cell_no', a.cell_no, 'label_no', {page_rules.beside('a')}.cell_no)), o -> o.label_no IS NOT NULL)")).alias("o"))
    return p.select("doc_id", "page_no", "o.*")


@_add("src_page_counts", f"SELECT doc_id, CAST(count(*) AS BIGINT) AS page_count FROM ({derived.PAGE}) z GROUP BY doc_id")
def _(spark, d):
    from ..sources.tables import page_counts

    return page_counts(table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id")))


@_add("snk_page_rows", f"{derived.sql_with('notes', 'seals')} SELECT doc_id, page_no, form_type, CAST(count(*) AS INT) AS lines, 3 AS seals FROM tnotes GROUP BY ALL")
def _(spark, d):
    return derived.pages(spark, d, "notes", "seals").select("doc_id", "page_no", "form_type", F.size("notes").alias("lines"), F.size("seals").alias("seals"))


# linear models over embeddings
@_add("ml_softmax", model.SOFTMAX_SQL)
def _(spark, d):
    return model.predicted(model.centroids(table(spark, d, "embeddings")), table(spark, d, "embeddings"))


@_add("ml_confusion", f"SELECT label AS truth, predicted, count(*) AS n FROM ({model.SOFTMAX_SQL}) p JOIN embeddings e USING (vec_id) GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return model.confusion(model.predicted(model.centroids(e), e).join(e.select("vec_id", "label"), "vec_id"))


@_add("ml_folds", "SELECT label, CAST(vec_id % 5 AS INT) AS fold, count(*) AS n FROM embeddings GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 5).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@_add("ml_fold_accuracy", f"SELECT round(avg(a), 4) AS mean, round(stddev_pop(a), 4) AS std, count(*) AS folds FROM (SELECT vec_id % 5 AS fold, avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) AS a FROM ({model.SOFTMAX_SQL}) p JOIN embeddings e USING (vec_id) GROUP BY 1) z")
def _(spark, d):
    e = table(spark, d, "embeddings")
    p = model.predicted(model.centroids(e), e).join(e.select("vec_id", "label"), "vec_id")
    fold = p.groupBy((F.col("vec_id") % 5).alias("fold")).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a"))
    return fold.agg(F.round(F.avg("a"), 4).alias("mean"), F.round(F.stddev_pop("a"), 4).alias("std"), F.count(F.lit(1)).alias("folds"))


_STATES = "CASE CAST(predicted % 4 AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'chipped' WHEN 2 THEN 'upside_down' ELSE 'faint' END"
for _r in ("B12", "B13"):

    @_add(f"{_r.lower()}_seal_state", f"SELECT * FROM (SELECT vec_id % 40 AS page, vec_id, {_STATES} AS state, CAST(row_number() OVER (PARTITION BY vec_id % 40 ORDER BY vec_id) AS INT) AS place FROM ({model.SOFTMAX_SQL}) p WHERE {_STATES} IN ({', '.join(repr(x) for x in c.BOOK[_r].params['reject_labels'])})) z WHERE place <= 12")
    def _(spark, d, _r=_r):
        e = table(spark, d, "embeddings")
        p = model.predicted(model.centroids(e), e).selectExpr("vec_id % 40 AS page", "vec_id", f"{_STATES} AS state", "1D AS p")
        return model.seal_findings(p, c.BOOK[_r].params, "page", "vec_id").select("page", "vec_id", "state", "place")


QUERIES, SQL = Q, S
