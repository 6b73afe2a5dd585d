"""Page rules over the derived pages, each with a relational SQL twin over unnested lines, cells and seals."""

from __future__ import annotations

from ..operators import page_rules
from ..sources import derived
from . import catalog as c

#: Rules for forms that the derived pages don't have run on a form they have.
BOOK = c.with_packs(c.BOOK, {r: {"include": ("质量证明单", "检验记录")} for r in ("F04", "F05", "F09", "F10", "F11")})
TEXT = tuple(f"A{i:02d}" for i in range(1, 14)) + ("B05", "B09")
TABLE = tuple(f"A{i}" for i in range(14, 19))
NOTES = ("F02", "F03", "F04", "F05", "F06", "F07", "F08", "F10", "F11", "F12")
PARTS = (
    {r: ("lines",) for r in TEXT}
    | {r: ("rows", "cells", "seals") for r in TABLE}
    | {r: ("notes",) for r in NOTES}
    | {"B01": ("seals",), "B02": ("seals",), "B03": ("lines", "seals"), "B04": ("cells", "seals"), "B06": ("lines", "segments"), "B07": ("rows", "cells", "seals"), "B08": ("lines",), "B10": ("lines",), "F01": ("cells",), "F09": ("cells",)}
)


def pages_for(spark, sf_dir: str, *parts: str, apart: bool = False):
    df = derived.pages(spark, sf_dir, *parts, apart=apart)
    for name in ("rows", "notes"):
        if name in parts:
            df = df.withColumnRenamed(name, "lines")
    return df


def query(rule: str):
    def run(spark, sf_dir: str):
        return page_rules.findings(pages_for(spark, sf_dir, *PARTS[rule]), rule, book=BOOK)

    return run


def _out(rule: str, frm: str, where: str = "true", no: str = "line_no", evidence: str = "text", detail: str = "NULL", conf: str = "0.5") -> str:
    return f"{derived.sql_with(*PARTS[rule])} SELECT doc_id, page_no, '{rule}' AS rule_id, CAST({no} AS INT) AS no, CAST({evidence} AS STRING) AS evidence, CAST({detail} AS STRING) AS detail, CAST({conf} AS DOUBLE) AS confidence FROM {frm} WHERE ({where}) AND ({BOOK[rule].applies()})"


def _match(rule: str, regex: str, conf: str, group: int = 0, keep: str = "true", line: str = "tlines") -> str:
    """One match a line at most in the derived lines; the group leaves out the boundaries that regex takes in."""
    return _out(rule, f"(SELECT *, regexp_extract(text, '{regex}', {group}) AS m FROM {line} WHERE regexp_matches(text, '{regex}')) z", keep, detail="m", conf=conf)


def _any(of: str, words) -> str:
    return "(" + " OR ".join(f"contains({of}, '{w}')" for w in words) + ")"


_NUM = r"[0-9]+(?:\.[0-9]+)?"
_UNIT = "|".join(sorted(c.UNITS, key=len, reverse=True))
_COPY = "contains(replace(text, ' ', ''), '与原件')"
_CX, _CY = "(x + w / 2.0)", "(y + h / 2.0)"
_KEYS = "doc_id, page_no, form_type"


def _first_line(lines: str, where: str) -> str:
    """The first matching line of each page."""
    return f"(SELECT * FROM {lines} WHERE {where} QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) = 1) z"


def _not_on_page(lines: str, where: str) -> str:
    return f"(doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM {lines} WHERE {where})"


def _has(lines: str, where: str) -> str:
    return f"(doc_id, page_no) IN (SELECT (doc_id, page_no) FROM {lines} WHERE {where})"


def _column(headers, lines: str = "trows") -> str:
    """Pages with a header: hdr_no, hx, hy, hh, x1, x2."""
    names = ", ".join(f"'{h.replace(' ', '')}'" for h in headers)
    head = f"(SELECT * FROM {lines} WHERE replace(text, ' ', '') IN ({names}) QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y + h / 2.0 DESC, line_no) = 1)"
    own = f"(SELECT a.doc_id, a.page_no, k.x, k.w FROM {head} a JOIN cells k ON a.doc_id = k.doc_id AND a.page_no = k.page_no AND a.x + a.w / 2.0 BETWEEN k.x AND k.x + k.w AND a.y + a.h / 2.0 BETWEEN k.y AND k.y + k.h QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_no ORDER BY k.w * k.h, k.cell_no) = 1)"
    return f"(SELECT a.doc_id, a.page_no, a.line_no AS hdr_no, a.text AS htext, a.x + a.w / 2.0 AS hx, a.y + a.h / 2.0 AS hy, a.h AS hh, coalesce(o.x, greatest(0, a.x - CAST(floor(a.w * 0.6) AS INT))) AS x1, coalesce(o.x + o.w, a.x + a.w + CAST(floor(a.w * 0.6) AS INT)) AS x2 FROM {head} a LEFT JOIN {own} o USING (doc_id, page_no))"


_LINE_COLS = "l.doc_id, l.page_no, l.form_type, l.line_no, l.text"


def _band(anchors: str, col: str) -> str:
    """Anchors a with the nearest line v of the column in their band."""
    return f"""(SELECT a.doc_id, a.page_no, a.form_type, a.line_no AS a_no, a.text AS a_text, v.line_no, v.text FROM {anchors} a JOIN {col} c USING (doc_id, page_no)
      JOIN trows v ON v.doc_id = a.doc_id AND v.page_no = a.page_no AND v.line_no <> a.line_no AND v.x + v.w / 2.0 BETWEEN c.x1 AND c.x2 AND abs((v.y + v.h / 2.0) - (a.y + a.h / 2.0)) <= greatest(a.h, 20) * 1.2
      QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.line_no ORDER BY abs((v.y + v.h / 2.0) - (a.y + a.h / 2.0)), v.line_no) = 1) z"""


_VERDICT = "replace(text, ' ', '') IN ('合格', '不合格', '符合', '合各')"
_MEASURED = rf"regexp_full_match(replace(text, ' ', ''), '[Φφ]?{_NUM}(\s*[～~]\s*[Φφ]?{_NUM})?[a-zA-Z℃%/]*')"
_DEC = lambda x: f"coalesce(list_max(list_transform(regexp_extract_all({x}, '[0-9]+[.]([0-9]+)', 1), lambda d: length(d))), 0)"
_POINTS = lambda x: "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract({x}, '[（(]([0-9]{{1,2}}) *处[)）]|(?:^|[^0-9.])([0-9]{{1,2}}) *- *[ΦR]|测量 *([0-9]{{1,2}}) *点', {i}), '') AS INT)" for i in (1, 2, 3)) + ")"
_CELL_SHARE_Y = "greatest(least(a.y + a.h, k.y + k.h) - greatest(a.y, k.y), 0)"


def _labelled(label: str) -> str:
    """The label's cell a on each page, with the value cell v beside it or nulls."""
    anchor = f"(SELECT * FROM cells WHERE replace(content, ' ', '') = '{label}' OR contains(content, '{label}') AND length(content) <= {len(label) + 4} QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE WHEN replace(content, ' ', '') = '{label}' THEN 0 ELSE 1 END, cell_no) = 1)"
    return f"""(SELECT a.doc_id, a.page_no, a.form_type, a.cell_no AS a_no, k.cell_no AS v_no, k.content FROM {anchor} a LEFT JOIN cells k ON a.doc_id = k.doc_id AND a.page_no = k.page_no AND k.x >= a.x + a.w * 0.8 AND {_CELL_SHARE_Y} > 0 AND {_CELL_SHARE_Y} >= 0.5 * least(a.h, k.h)
      QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_no ORDER BY k.x, k.cell_no) = 1) z"""


def _cover(a: str, b: str) -> str:
    return f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0) / CAST(greatest({a}.w * {a}.h, 1) AS DOUBLE))"


def _blank_cells() -> str:
    blank = f"(SELECT a.* FROM cells a WHERE a.w * a.h / 1400000.0 BETWEEN 0.0008 AND 0.06 AND trim(a.content) = '' AND a.ink <= 0.004 AND NOT EXISTS (SELECT 1 FROM seals s WHERE s.doc_id = a.doc_id AND s.page_no = a.page_no AND {_cover('a', 's')} > 0.15))"
    up = f"(SELECT a.doc_id, a.page_no, a.cell_no, k.content FROM {blank} a JOIN cells k ON a.doc_id = k.doc_id AND a.page_no = k.page_no AND k.y + k.h <= a.y AND k.content <> '' AND least(a.x + a.w, k.x + k.w) > greatest(a.x, k.x) AND least(a.x + a.w, k.x + k.w) - greatest(a.x, k.x) >= 0.6 * least(a.w, k.w) QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.cell_no ORDER BY a.y - (k.y + k.h), k.cell_no) = 1)"
    side = f"(SELECT a.doc_id, a.page_no, a.cell_no, k.content FROM {blank} a JOIN cells k ON a.doc_id = k.doc_id AND a.page_no = k.page_no AND k.x + k.w <= a.x AND k.content <> '' AND {_CELL_SHARE_Y} > 0 AND {_CELL_SHARE_Y} >= 0.5 * least(a.h, k.h) QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.cell_no ORDER BY a.x - (k.x + k.w), k.cell_no) = 1)"
    named = f"(SELECT b.doc_id, b.page_no, b.form_type, b.cell_no, coalesce(left(u.content, 14), '') AS up, coalesce(left(d.content, 14), '') AS side FROM {blank} b LEFT JOIN {up} u USING (doc_id, page_no, cell_no) LEFT JOIN {side} d USING (doc_id, page_no, cell_no))"
    kept = f"(SELECT *, CASE WHEN up <> '' THEN up ELSE side END AS name FROM {named} n WHERE NOT {_any('up', c.DOWNSTREAM)} AND NOT {_any('side', c.DOWNSTREAM)})"
    counted = f"(SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, name) AS cnt FROM {kept} k WHERE {_any('name', c.CELL_FIELDS)})"
    return f"(SELECT DISTINCT doc_id, page_no, form_type, CASE WHEN cnt < 3 THEN cell_no END AS line_no, name AS text, CASE WHEN cnt < 3 THEN 1 ELSE cnt END AS cnt FROM {counted} y) z"


def _struck() -> str:
    return """(SELECT g.doc_id, g.page_no, g.form_type, count(*) AS n FROM segments g WHERE g.w >= 40 AND g.w / CAST(greatest(g.h, 1) AS DOUBLE) >= 8 AND EXISTS (
      SELECT 1 FROM tlines l WHERE l.doc_id = g.doc_id AND l.page_no = g.page_no AND l.h >= 8 AND l.w >= 30 AND g.w >= l.h * 2 AND g.y + g.h / 2.0 BETWEEN l.y + l.h * 0.2 AND l.y + l.h * 0.8
        AND least(g.x + g.w, l.x + l.w) > greatest(g.x, l.x) AND least(g.x + g.w, l.x + l.w) - greatest(g.x, l.x) >= 0.5 * l.w AND g.w <= l.w * 1.3)
      GROUP BY ALL) z"""


_MARK, _CUR = "共 *[0-9]+ *页", "第 *[0-9]+ *页"
_HARD = f"regexp_matches(text, '{_NUM} *(HRC|HBW|HRB|HB|HV)')"
_NO_WORDS = lambda where: _not_on_page("tnotes", where)
_PAGE = f"(SELECT DISTINCT {_KEYS}, red_ratio, blue_ratio, height, NULL AS line_no, NULL AS text FROM %s) z"

ORACLES = {
    "A01": _match("A01", "(?:^|[^0-9])((?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})(?:$|[^0-9])", "0.85", 1, "contains(m, '-') OR contains(m, '/') OR length(m) <> 10"),
    "A02": f"""{_match("A02", f"(?:^|[^0-9-])({_NUM} *(?:{_UNIT})? *[-－–—] *{_NUM} *(?:{_UNIT})?)", "0.9", 1, f"regexp_matches(m, '{_UNIT}')")}
      UNION ALL SELECT doc_id, page_no, 'A02', line_no, text, regexp_extract(text, 'Φ *{_NUM} *[-－–—] *Φ? *{_NUM}'), 0.9 FROM tlines WHERE regexp_matches(text, 'Φ *{_NUM} *[-－–—] *Φ? *{_NUM}')""",
    "A03": _out("A03", "tlines", _any("text", c.DIAMETERS), detail="array_to_string(list_filter([" + ", ".join(f"'{d}'" for d in c.DIAMETERS) + "], lambda k: contains(text, k)), '、')", conf="0.7"),
    "A04": _match("A04", f"Φ *{_NUM} *[～~] *{_NUM}", "0.85"),
    "A05": _match("A05", f"({_NUM} *mm)(?:$|[^a-zA-Z/])", "0.6", 1),
    "A06": _out("A06", "(SELECT l.*, u.unit FROM tlines l, (SELECT unnest([" + ", ".join(f"'{u}'" for u in c.UNIT_CASE) + "]) AS unit) u WHERE regexp_matches(l.text, '[0-9] *' || u.unit || '($|[^a-zA-Z])')) z", detail="unit", conf="0.8"),
    "A07": _match("A07", "(m *[23²³])(?:$|[^0-9])", "0.6", 1),
    "A08": _match("A08", "[零一二三四五六七八九十百千两]{1,6} *(?:公斤|千克|摄氏度|毫米|厘米|米|吨|克)", "0.7"),
    "A09": _out("A09", _first_line("tlines", f"regexp_matches(text, '{_MARK}|{_CUR}')"), f"page_count >= 2 AND {_not_on_page('tlines', f'regexp_matches(text, {chr(39)}{_MARK}{chr(39)}) AND (CAST(regexp_extract(text, {chr(39)}共 *([0-9]+) *页{chr(39)}, 1) AS INT) <= 1 OR regexp_matches(text, {chr(39)}{_CUR}{chr(39)}))')}", conf="0.6"),
    "A10": _match("A10", r"[0-9]+\.[0-9]{4,}", "0.7", 0, f"NOT regexp_matches(text, '[A-Za-z]') AND {_has('tlines', _any('text', c.WEIGHING))}"),
    "A11": _match("A11", rf"\( *- *({_NUM}) *[～~] *\+? *({_NUM}) *\)", "0.8", 0, rf"abs(CAST(regexp_extract(text, '\( *- *({_NUM}) *[～~] *\+? *({_NUM}) *\)', 1) AS DOUBLE) - CAST(regexp_extract(text, '\( *- *({_NUM}) *[～~] *\+? *({_NUM}) *\)', 2) AS DOUBLE)) < 1e-9"),
    "A12": _out("A12", f"(SELECT a.* FROM {_first_line('tlines', 'contains(text, ' + chr(39) + '特殊记载' + chr(39) + ')').removesuffix(' z')} a WHERE NOT contains(replace(a.text, '特殊记载', ''), '无') AND NOT EXISTS (SELECT 1 FROM tlines v WHERE v.doc_id = a.doc_id AND v.page_no = a.page_no AND v.line_no <> a.line_no AND v.y + v.h / 2.0 BETWEEN a.y - a.h AND a.y + 4 * a.h AND v.x + v.w / 2.0 > a.x + a.w / 2.0)) z", conf="0.55"),
    "A13": _out("A13", "tlines", f"{_COPY} AND NOT contains(replace(text, ' ', ''), '{c.COPY_WORDING}')", conf=f"CASE WHEN {_any('replace(text, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) * 2 + ')', c.COPY_VARIANTS)} THEN 0.9 ELSE 0.6 END"),
    "A14": _out("A14", f"(SELECT *, bool_or({_VERDICT}) OVER p AND bool_or({_MEASURED}) OVER p AS mixed FROM (SELECT l.* FROM trows l JOIN {_column(c.RESULT_HEADERS)} c USING (doc_id, page_no) WHERE l.line_no <> c.hdr_no AND l.y + l.h / 2.0 > c.hy AND l.x + l.w / 2.0 BETWEEN c.x1 AND c.x2) WINDOW p AS (PARTITION BY doc_id, page_no) QUALIFY {_VERDICT} AND row_number() OVER (PARTITION BY doc_id, page_no, {_VERDICT} ORDER BY line_no) = 1) z", "mixed", conf="0.6"),
    "A15": _out("A15", f"(SELECT a.doc_id, a.page_no, a.form_type, v.line_no, v.text, a.text AS a_text FROM trows a JOIN {_column(c.ACTUAL_HEADERS)} c USING (doc_id, page_no) JOIN trows v ON v.doc_id = a.doc_id AND v.page_no = a.page_no WHERE {_any('a.text', c.QUANTITIES)} AND a.y + a.h / 2.0 > c.hy AND v.x + v.w / 2.0 BETWEEN c.x1 AND c.x2 AND abs((v.y + v.h / 2.0) - (a.y + a.h / 2.0)) <= greatest(a.h, 20) * 1.2 AND regexp_full_match(replace(v.text, ' ', ''), '{_NUM}')) z", detail="a_text", conf="0.6"),
    "A16": _out("A16", _band(f"(SELECT l.* FROM trows l JOIN {_column(c.ACTUAL_HEADERS)} c USING (doc_id, page_no) WHERE l.y + l.h / 2.0 > c.hy AND l.x + l.w / 2.0 < c.x1 AND {_POINTS('l.text')} BETWEEN 2 AND 5)", _column(c.ACTUAL_HEADERS)), "regexp_matches(text, '[～~]')", conf="0.6"),
    "A17": _out("A17", _band(f"(SELECT l.* FROM trows l JOIN {_column(c.SPEC_HEADERS)} c USING (doc_id, page_no) WHERE l.y + l.h / 2.0 > c.hy AND l.x + l.w / 2.0 BETWEEN c.x1 AND c.x2 AND {_DEC('l.text')} > 0)", _column(c.ACTUAL_HEADERS)), f"{_DEC('text')} > 0 AND {_DEC('text')} < {_DEC('a_text')}", detail=_DEC("a_text"), conf="0.55"),
    "A18": _out("A18", f"(SELECT a.* FROM {_first_line('trows', _any('replace(text, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) * 2 + ')', c.REVIEWERS)).removesuffix(' z')} a WHERE EXISTS (SELECT 1 FROM trows v WHERE v.doc_id = a.doc_id AND v.page_no = a.page_no AND contains(replace(v.text, ' ', ''), '与原件')) AND NOT EXISTS (SELECT 1 FROM trows v WHERE v.doc_id = a.doc_id AND v.page_no = a.page_no AND v.line_no <> a.line_no AND abs((v.y + v.h / 2.0) - (a.y + a.h / 2.0)) <= greatest(a.h, 20) * 1.4 AND v.x + v.w / 2.0 > a.x + a.w / 2.0 AND regexp_replace(v.text, '[\\s:：]', '', 'g') <> '' AND NOT {_any('v.text', c.REVIEWERS)}) AND NOT EXISTS (SELECT 1 FROM seals s WHERE s.doc_id = a.doc_id AND s.page_no = a.page_no AND s.x + s.w / 2.0 > a.x AND abs((s.y + s.h / 2.0) - (a.y + a.h / 2.0)) <= greatest(a.h, 20) * 1.4)) z", conf="0.5"),
    "B01": _out("B01", "seals", "fill >= 0.18 AND rect >= 0.8 AND abs(angle) > 10", "seal_no", "NULL", "printf('%.1f', angle)", "0.6"),
    "B02": _out("B02", f"(SELECT s.*, o.seal_no AS other FROM seals s JOIN seals o ON s.doc_id = o.doc_id AND s.page_no = o.page_no AND s.seal_no < o.seal_no WHERE s.fill >= 0.18 AND o.fill >= 0.18 AND s.area >= 840 AND o.area >= 840 AND greatest({_cover('s', 'o')}, {_cover('o', 's')}) >= 0.5) z", "true", "seal_no", "NULL", "other", "0.7"),
    "B03": _out("B03", f"(SELECT l.*, s.seal_no FROM tlines l JOIN seals s ON s.doc_id = l.doc_id AND s.page_no = l.page_no WHERE regexp_matches(l.text, '(?:19|20)[0-9]{{2}} *[./年-] *[0-9]{{1,2}} *[./月-] *[0-9]{{1,2}}') AND l.line_red <= 0.02 AND s.fill >= 0.18 AND {_cover('l', 's')} >= 0.25) z", "true", "seal_no", "text", "line_no", "0.65"),
    "B04": _out("B04", _blank_cells(), detail="cnt", conf="CASE WHEN line_no IS NULL THEN 0.5 ELSE 0.4 END"),
    "B05": _out("B05", "tlines", f"{_COPY} AND NOT ({_CX} / width >= 0.5 AND {_CY} / height >= 0.6)", conf="0.75"),
    "B06": _out("B06", _struck(), "n > 3", "NULL", "NULL", "n", "0.4"),
    "B07": _out("B07", f"""(SELECT p.doc_id, p.page_no, p.form_type, c.hdr_no AS line_no, c.htext AS text FROM (SELECT DISTINCT doc_id, page_no, form_type, column_red, row_red FROM trows) p JOIN {_column(c.INSPECTORS)} c USING (doc_id, page_no)
      WHERE p.column_red <= 0.002 AND p.row_red <= 0.002 AND NOT EXISTS (SELECT 1 FROM trows v WHERE v.doc_id = p.doc_id AND v.page_no = p.page_no AND contains(replace(v.text, ' ', ''), '与原件'))
      AND NOT EXISTS (SELECT 1 FROM seals s WHERE s.doc_id = p.doc_id AND s.page_no = p.page_no AND s.fill >= 0.18 AND (s.x + s.w / 2.0 BETWEEN c.x1 AND c.x2 AND s.y + s.h / 2.0 > c.hy OR s.x + s.w / 2.0 > c.hx AND s.y + s.h / 2.0 BETWEEN c.hy - greatest(c.hh, 20) * 1.2 AND c.hy + greatest(c.hh, 20) * 1.6))
      AND (SELECT count(*) FROM trows l WHERE l.doc_id = p.doc_id AND l.page_no = p.page_no AND l.y + l.h / 2.0 > c.hy + c.hh AND l.x + l.w / 2.0 < c.x1) >= 2) z""", conf="0.5"),
    "B08": _out("B08", _PAGE % "tlines", f"red_ratio < 0.00002 AND {_not_on_page('tlines', _COPY)}", conf="0.7"),
    "B09": _out("B09", _first_line("tlines", f"regexp_matches(text, '{_CUR}|{_MARK}')"), f"NOT ({_CY} / height >= 0.88 AND {_CX} / width BETWEEN 0.33 AND 0.67)", conf="0.6"),
    "B10": _out("B10", _PAGE % "tlines", "blue_ratio >= 0.0006", conf="0.5"),
    "F01": _out("F01", _labelled("装配处"), "replace(content, ' ', '') IN ('/', '／', chr(92))", "v_no", "content", "NULL", "0.8"),
    "F02": _out("F02", _PAGE % "tnotes", _NO_WORDS(_any("text", ("设计图版次", "图纸版次"))), conf="0.5"),
    "F03": _out("F03", _first_line("tnotes", "contains(text, '呈报')"), _NO_WORDS(f"regexp_matches(text, '{_MARK}')"), conf="0.6"),
    "F04": _out("F04", _PAGE % "tnotes", "red_ratio < 0.00002", conf="0.7"),
    "F05": _out("F05", _first_line("tnotes", _any("text", c.REPAIR_WORDS)), _NO_WORDS(_any("text", c.CLOSED_WORDS)), conf="0.5"),
    "F06": _out("F06", f"(SELECT z.*, array_to_string(list_filter(['零件号', '批次'], lambda k: NOT contains(words, k)), '、') AS missing FROM (SELECT {_KEYS}, string_agg(text, ' ') AS words FROM tnotes GROUP BY ALL) z) z", "page_no = 1 AND missing <> ''", "NULL", "NULL", "missing", "0.55"),
    "F07": _out("F07", _first_line("tnotes", _any("text", c.REJECT_WORDS)), _NO_WORDS("contains(text, '拒收单')"), conf="0.5"),
    "F08": _out("F08", f"(SELECT a.* FROM {_first_line('tnotes', _HARD).removesuffix(' z')} a JOIN (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY floor({_CY} / 20), {_CX}, line_no) AS words, bool_or({_HARD} AND regexp_matches(text, '[～~]')) AS ranged FROM tnotes GROUP BY ALL) w USING (doc_id, page_no) WHERE NOT (w.ranged AND NOT contains(w.words, '抽检') OR regexp_matches(w.words, '抽检\\s*[0-9]+'))) z", conf="0.45"),
    "F09": _out("F09", _labelled("入库箱数"), "trim(coalesce(content, '')) = ''", "coalesce(v_no, a_no)", "'入库箱数'", "NULL", "0.6"),
    "F10": _out("F10", _PAGE % "tnotes", _NO_WORDS(f"{_CY} > height * 0.62 AND {_any('text', c.PAIRING_WORDS)}"), conf="0.5"),
    "F11": _out("F11", _PAGE % "tnotes", _NO_WORDS(f"{_CY} > height * 0.62 AND (regexp_matches(text, '[0-9]{{2,4}} *- *[0-9]{{1,2}} *- *[0-9]{{1,3}}') OR contains(text, '不涉及呈报'))"), conf="0.45"),
    "F12": _out("F12", _first_line("tnotes", "contains(text, '呈报')"), _NO_WORDS("contains(text, '闭环') OR contains(text, '不涉及呈报')"), conf="0.5"),
}

NAMES = {
    "A01": "date_format", "A02": "range_symbol", "A03": "diameter_symbol", "A04": "diameter_range", "A05": "unit_mm", "A06": "unit_case", "A07": "square_cubic", "A08": "chinese_numeral", "A09": "page_number",
    "A10": "decimal_precision", "A11": "tolerance", "A12": "special_record", "A13": "copy_wording", "A14": "result_consistency", "A15": "missing_unit", "A16": "multi_point", "A17": "rounding", "A18": "reviewer",
    "B01": "seal_tilt", "B02": "seal_overlap", "B03": "seal_on_date", "B04": "blank_cell", "B05": "copy_position", "B06": "struck_lines", "B07": "inspector_seal", "B08": "page_red", "B09": "number_position", "B10": "pen_color",
    "F01": "assembly_slash", "F02": "design_version", "F03": "report_pages", "F04": "repair_seal", "F05": "repair_closure", "F06": "inspection_header", "F07": "reject_note", "F08": "hardness", "F09": "label_quantity", "F10": "substitute", "F11": "report_batch", "F12": "certificate_closure",
}


def all_text_rules(spark, sf_dir: str):
    """Every enabled rule that reads lines alone, over all pages, in one scan: findings with the catalog's level and title."""
    from pyspark.sql import functions as F

    found = page_rules.findings(pages_for(spark, sf_dir, "lines", apart=True))
    return found.join(F.broadcast(c.as_table(spark)), "rule_id").select("doc_id", "page_no", "rule_id", "level", "title", "no", "evidence", "detail", "confidence")


_ALL = [r for r in TEXT + ("B08", "B10") if c.BOOK[r].enabled] + ["F02", "F03", "F06", "F07", "F08", "F12"]
_ON_LINES = {r: ORACLES[r].split(derived.sql_with(*PARTS[r]), 1)[1].replace("tnotes", "tlines") for r in _ALL}
_CATALOG = ", ".join(f"('{r.id}', '{r.level}', '{r.title.replace(chr(39), chr(39) * 2)}')" for r in c.RULES)
ALL_SQL = f"{derived.sql_with('lines')}, found AS ({' UNION ALL '.join(_ON_LINES[r] for r in _ALL)}) SELECT doc_id, page_no, rule_id, level, title, no, evidence, detail, confidence FROM found JOIN (VALUES {_CATALOG}) k(rule_id, level, title) USING (rule_id)"

#: Rules under other parameters: name -> rule, parameters, and the twin's text with what they change in it.
CHANGED = {
    "b01_tilt_over_89": ("B01", {"max_tilt_deg": 89}, ORACLES["B01"].replace("abs(angle) > 10", "abs(angle) > 89")),
    "b01_tilt_over_15": ("B01", {"max_tilt_deg": 15}, ORACLES["B01"].replace("abs(angle) > 10", "abs(angle) > 15")),
    "a09_in_order": ("A09", {"strict_order": True}, ORACLES["A09"].replace(f"OR regexp_matches(text, '{_CUR}'))", "OR regexp_matches(text, '第 *[0-9]+ *页 *[，,、 ]? *共 *[0-9]+ *页'))")),
    "a09_missing": ("A09", {"flag_missing": True, "min_pages": 3}, f"""{ORACLES["A09"].replace("page_count >= 2", "page_count >= 3")} UNION ALL SELECT doc_id, page_no, 'A09', CAST(NULL AS INT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0.5
      FROM (SELECT doc_id, page_no, form_type, page_count, bool_or(regexp_matches(text, '{_MARK}|{_CUR}')) AS told FROM tlines GROUP BY ALL) z WHERE page_count >= 3 AND NOT told AND ({BOOK["A09"].applies()})"""),
    "a10_two_decimals": ("A10", {"max_decimals": 2}, ORACLES["A10"].replace("{4,}", "{3,}")),
    "a18_missing_field": ("A18", {"flag_missing_field": True, "labels": ("复核人",)}, f"""{ORACLES["A18"].replace("(contains(replace(text, ' ', ''), '复核人') OR contains(replace(text, ' ', ''), '负责人') OR contains(replace(text, ' ', ''), '审核人'))", "contains(replace(text, ' ', ''), '复核人')").replace("NOT (contains(v.text, '复核人') OR contains(v.text, '负责人') OR contains(v.text, '审核人'))", "NOT contains(v.text, '复核人')")}
      UNION ALL SELECT doc_id, page_no, 'A18', CAST(NULL AS INT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0.35 FROM (SELECT doc_id, page_no, form_type, bool_or({_COPY}) AS copied, bool_or(contains(replace(text, ' ', ''), '复核人')) AS named FROM trows GROUP BY ALL) z WHERE copied AND NOT named AND ({BOOK["A18"].applies()})"""),
    "b04_all_fields": ("B04", {"check_all_fields": True, "group_as_column": 2}, ORACLES["B04"].replace(f" WHERE {_any('name', c.CELL_FIELDS)}", "").replace("cnt < 3", "cnt < 2")),
    "b07_copies_too": ("B07", {"skip_copy_pages": False, "region_red_ratio": 0.001}, ORACLES["B07"].replace("_red <= 0.002", "_red <= 0.001").replace(" AND NOT EXISTS (SELECT 1 FROM trows v WHERE v.doc_id = p.doc_id AND v.page_no = p.page_no AND contains(replace(v.text, ' ', ''), '与原件'))", "")),
}


def changed(rule: str, params: dict):
    def run(spark, sf_dir: str):
        return page_rules.findings(pages_for(spark, sf_dir, *PARTS[rule]), rule, book=c.with_packs(BOOK, {rule: {"params": params}}))

    return run


QUERIES = {f"{r.lower()}_{n}": query(r) for r, n in NAMES.items()} | {n: changed(r, p) for n, (r, p, _) in CHANGED.items()}
SQL = {f"{r.lower()}_{n}": ORACLES[r] for r, n in NAMES.items()} | {n: sql for n, (_, _, sql) in CHANGED.items()}
QUERIES["all_text_rules"], SQL["all_text_rules"] = all_text_rules, ALL_SQL


#: Damage to the derived pages: condition over page_no, and what is lost there.
_DAMAGE = {"text": ("page_no % 3 = 1", "line 2 has no text"), "form": ("page_no % 4 = 2", "no form"), "seals": ("page_no % 5 = 3", "no list of seals"), "height": ("page_no % 6 = 5", "a height of 0"), "far": ("page_no % 3 = 2", "line 5 lies beyond 32 bits"), "line": ("page_no % 7 = 4", "a null among the lines")}


def odd_pages(spark, sf_dir: str):
    """The text rules and B01 over damaged pages: what is sound is found all the same, and rules that can't be checked say so."""
    from pyspark.sql import functions as F

    df, when = pages_for(spark, sf_dir, "lines", "seals", apart=True), {k: v[0] for k, v in _DAMAGE.items()}
    hurt = f"transform(lines, l -> named_struct('line_no', l.line_no, 'text', if({when['text']} AND l.line_no = 2, NULL, l.text), 'x', if({when['far']} AND l.line_no = 5, 2147483647, l.x), 'y', l.y, 'w', l.w, 'h', l.h, 'red_ratio', l.red_ratio))"
    df = df.withColumn("lines", F.expr(f"if({when['line']}, concat(array(NULL), {hurt}), {hurt})"))
    df = df.withColumns({"form_type": F.expr(f"if({when['form']}, NULL, form_type)"), "seals": F.expr(f"if({when['seals']}, NULL, seals)"), "height": F.expr(f"if({when['height']}, 0, height)")})
    return page_rules.findings(df, *_ODD, book=BOOK)


_ODD = [r for r in _ALL if r in TEXT] + ["B01"]
_NEEDS_HEIGHT = tuple(r for r in ("B05", "B09") if r in _ODD)
_ODD_FORM = f"CASE WHEN {_DAMAGE['form'][0]} THEN '{c.UNKNOWN_FORM}' ELSE form_type END"
_FAILED = lambda rule, when: f"SELECT doc_id, page_no, '{rule}' AS rule_id, CAST(NULL AS INT) AS no, CAST(NULL AS VARCHAR) AS evidence, '{page_rules.FAILED}' AS detail, 0.0 AS confidence FROM page WHERE {when} AND ({BOOK[rule].applies(_ODD_FORM)})"
_ODD_SQL = " UNION ALL ".join(
    [f"SELECT * FROM ({_ON_LINES.get(r) or ORACLES[r].split(derived.sql_with(*PARTS[r]), 1)[1]}) z" + (f" WHERE NOT ({_DAMAGE['height'][0]})" if r in _NEEDS_HEIGHT else "") for r in _ODD]
    + [_FAILED(r, _DAMAGE["height"][0]) for r in _NEEDS_HEIGHT]
    + [_FAILED("B01", _DAMAGE["seals"][0])]
)
QUERIES["odd_pages"] = odd_pages
SQL["odd_pages"] = f"""{derived.sql_with("lines", "seals").replace("tlines AS (", "tlines0 AS (").replace("seals AS (", "seals0 AS (")},
  tlines AS (SELECT * REPLACE ({_ODD_FORM} AS form_type, CASE WHEN {_DAMAGE["text"][0]} AND line_no = 2 THEN '' ELSE text END AS text) FROM tlines0),
  seals AS (SELECT * REPLACE ({_ODD_FORM} AS form_type) FROM seals0 WHERE NOT ({_DAMAGE["seals"][0]})) {_ODD_SQL}"""
