"""Page rules as expressions over one nested page row: no join, no shuffle, one scan for the whole catalog.

A page row has doc_id, page_no, page_count, form_type, width, height, red_ratio, blue_ratio and arrays lines, cells, seals and
segments. Where they are known, lines carry their own red_ratio, and the page column_red and row_red, the red shares below the
inspector's header and right of it; B03 and B07 read them, and fall back to "not red" and to the page's share. Rules read
helper columns (page text, column ranges) that `prepared` adds once. Each rule is a function of its parameters that gives SQL
for an array of findings: no (line, cell or seal number, null for the page), evidence, detail, confidence, and a box where it
isn't that of the line, cell or seal; or, for a rule that looks at one line at a time, PerLine. Lambdas are interpreted, so
`told` deals a page's lines out as rows, over which such rules are compiled.

Odd pages lose nothing but what is odd: null lines, cells, seals and strokes are left out, null texts are empty, a null form
is the unknown one, boxes are summed in 64 bits. Where a page lacks what a rule reads (an array, a size, a red share), or
the rule gives null, the page gets one finding of the rule with detail FAILED and confidence 0, and all other rules run.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions import text as t
from ..plans import catalog as c

BOX = "struct<x:int,y:int,w:int,h:int>"
FINDING = f"struct<no:int,evidence:string,detail:string,confidence:double,box:{BOX}>"
NONE = f"CAST(array() AS array<{FINDING}>)"
#: The detail of a finding that says of a rule that it couldn't be checked on a page.
FAILED = "could not be checked"


def _in(words) -> str:
    return ", ".join(t.quoted(w) for w in words)


def _any(text: str, words) -> str:
    return "false" if not words else f"exists(array({_in(words)}), k -> contains({text}, k))"


def _one_of(text: str, words) -> str:
    """The same for short texts: a search for plain words that spares most lines a regular expression."""
    return f"({' OR '.join(f'contains({text}, {t.quoted(w)})' for w in words)})"


def finding(no: str, evidence: str, detail: str, confidence: object, box: str = "NULL") -> str:
    conf = confidence if isinstance(confidence, str) else f"{confidence}D"
    return f"named_struct('no', try_cast({no} AS INT), 'evidence', CAST({evidence} AS STRING), 'detail', CAST({detail} AS STRING), 'confidence', {conf}, 'box', CAST({box} AS {BOX}))"


def box(x: str, y: str, w: str, h: str) -> str:
    return f"named_struct('x', try_cast({x} AS INT), 'y', try_cast({y} AS INT), 'w', try_cast({w} AS INT), 'h', try_cast({h} AS INT))"


def around(items: str) -> str:
    """The box around an array of boxes."""
    low = lambda f: f"array_min(transform(bs, b -> b.{f}))"
    high = lambda f, w: f"array_max(transform(bs, b -> b.{f} + b.{w}))"
    return f"transform(array({items}), bs -> {box(low('x'), low('y'), high('x', 'w') + ' - ' + low('x'), high('y', 'h') + ' - ' + low('y'))})[0]"


@dataclass(frozen=True)
class PerLine:
    """A rule over single lines: a finding for each of `details` (SQL over a line l, an array of texts) where `when` holds, on pages where `page` does."""

    when: str
    details: str
    confidence: object
    page: str = "true"

    def array(self) -> str:
        """SQL for the findings of all of a page's lines."""
        found = f"flatten(transform(filter(lines, l -> {self.when}), l -> transform({self.details}, m -> {finding('l.line_no', 'l.text', 'm', self.confidence)})))"
        return found if self.page == "true" else f"if({self.page}, {found}, {NONE})"


def array_sql(rule: str | PerLine) -> str:
    return rule.array() if isinstance(rule, PerLine) else rule


def matches(regex: str, keep: str = "true") -> str:
    """The matches m of regex in a line l that keep holds for."""
    found = t.all_matches("l.text", regex)
    return found if keep == "true" else f"filter({found}, m -> {keep})"


def per_match(regex: str, confidence: float, keep: str = "true", when: str = "true", words: tuple[str, ...] = (), page: str = "true") -> PerLine:
    """A finding for each match m of regex in a line l. words: plain words of which every match has one; lines without any aren't searched."""
    return PerLine(_one_of("l.text", words) if words else when, matches(regex, keep), confidence, page)


def per_line(keep: str, detail: str, confidence: object) -> PerLine:
    return PerLine(keep, f"array(CAST({detail} AS STRING))", confidence)


def page_finding(when: str, confidence: float, line: str | None = None, where: str = "NULL") -> str:
    """One finding of the page, with a line if SQL for one is given, where `when` holds."""
    no, evidence = (f"{line}.line_no", f"{line}.text") if line else ("NULL", "NULL")
    return f"if({when}, array({finding(no, evidence, 'NULL', confidence, where)}), {NONE})"


def column(headers) -> str:
    """SQL for the lowest header's column: hdr, x1, x2; null without a header, which pages without its words aren't searched for."""
    words = sorted({h.replace(" ", "") for h in headers})
    wanted = _in(words)
    lowest = f"array_max(transform(filter(lines, l -> {t.bare('l.text')} IN ({wanted})), l -> named_struct('k', {g.cy('l')}, 'no', -l.line_no, 'l', l))).l"
    cell = g.owner("cells", g.cx("h"), g.cy("h"))
    x1, x2 = "greatest(0, h.x - CAST(floor(h.w * 0.6D) AS INT))", "h.x + h.w + CAST(floor(h.w * 0.6D) AS INT)"
    ranged = f"transform(array({cell}), o -> named_struct('hdr', h, 'x1', coalesce(o.x, {x1}), 'x2', coalesce(o.x + o.w, {x2})))[0]"
    return f"if({_one_of('bare_text', words)}, get(transform(filter(array({lowest}), h -> h IS NOT NULL), h -> {ranged}), 0), NULL)"


def band_value(anchor: str, col: str, factor: float = 1.2) -> str:
    """The line of a column nearest to an anchor's height within the band."""
    near = f"filter(lines, v -> v.line_no <> {anchor}.line_no AND {g.cx('v')} BETWEEN {col}.x1 AND {col}.x2 AND abs({g.cy('v')} - {g.cy(anchor)}) <= greatest({anchor}.h, 20) * {factor}D)"
    return g.nearest(near, f"abs({g.cy('e')} - {g.cy(anchor)})", "line_no")


def label_cell(label: str) -> str:
    """The first cell that is the label, else the first that holds it and little more."""
    exact = f"{t.bare('k.content')} = {label}"
    fits = f"filter(cells, k -> {exact} OR contains(k.content, {label}) AND length(k.content) <= length({label}) + 4)"
    return g.nearest(fits, f"if({t.bare('e.content')} = {label}, 0, 1)", "cell_no")


def value_cell(anchor: str) -> str:
    """The nearest cell to the right of an anchor, on its row."""
    # cells quite above or below go first; a size that isn't known parts nothing
    apart = f"coalesce(k.y >= {g.bottom(anchor)}, false) OR coalesce({g.bottom('k')} <= {anchor}.y, false)"
    row = f"filter(cells, k -> k.x >= {anchor}.x + {anchor}.w * 0.8D AND NOT ({apart}) AND {g.shared_y(anchor, 'k')} > 0 AND {g.shared_y(anchor, 'k')} >= 0.5D * least({anchor}.h, k.h))"
    return g.nearest(row, f"e.x - ({anchor}.x + {anchor}.w)", "cell_no")


def above(cell: str) -> str:
    """The header over a cell: the nearest written cell above it that shares 60 % of the smaller width."""
    fits = f"filter(cells, k -> k.y + k.h <= {cell}.y AND k.content <> '' AND {g.shared_x(cell, 'k')} > 0 AND {g.shared_x(cell, 'k')} >= 0.6D * least({cell}.w, k.w))"
    return g.nearest(fits, f"{cell}.y - (e.y + e.h)", "cell_no")


def beside(cell: str) -> str:
    """The label left of a cell: the nearest written cell that shares half of the smaller height."""
    fits = f"filter(cells, k -> k.x + k.w <= {cell}.x AND k.content <> '' AND {g.shared_y(cell, 'k')} > 0 AND {g.shared_y(cell, 'k')} >= 0.5D * least({cell}.h, k.h))"
    return g.nearest(fits, f"{cell}.x - (e.x + e.w)", "cell_no")


PAGE_TEXT = f"array_join(sort_array(transform(lines, l -> named_struct('b', floor({g.cy('l')} / 20), 'x', {g.cx('l')}, 'n', l.line_no, 't', l.text))).t, '\\n')"
#: Red shares that a page row may carry; findings() puts in what the row has.
RED_LINE, COLUMN_RED, ROW_RED = "@line_red@", "@column_red@", "@row_red@"
BLANK = "size(lines) < 3"
COPY = f"exists(lines, l -> contains({t.bare('l.text')}, '与原件'))"
STAMPS = "filter(seals, s -> s.fill >= 0.18D)"
DATE = r"(?<!\d)((?:19|20)\d{2})([./-])(\d{1,2})([./-])(\d{1,2})(?!\d)"

ANY_DATE = r"(?:19|20)\d{2}\s*[.\-/年]\s*\d{1,2}\s*[.\-/月]\s*\d{1,2}"
BATCH = r"\d{2,4}\s*-\s*\d{1,2}\s*-\s*\d{1,3}"

#: Columns that prepared() adds: name -> rule and parameter that give the headers (a rule's own, or a fixed list).
COLUMNS = {"result_column": ("A14", "column_headers"), "listed_column": ("A16", "actual_headers"), "measured_column": ("A17", "actual_headers"), "spec_column": ("A17", "spec_headers"), "inspector_column": ("B07", "column_headers")}


def helpers(book: dict) -> dict[str, tuple[str, tuple[str, ...]]]:
    """name -> SQL, and the arrays it needs."""
    out = {"page_text": (PAGE_TEXT, ("lines",)), "actual_column": (column(c.ACTUAL_HEADERS), ("lines", "cells"))}
    return out | {name: (column(book[rule].params[key]), ("lines", "cells")) for name, (rule, key) in COLUMNS.items() if rule in book}


def sound(pages: DataFrame) -> DataFrame:
    """pages without null entries and null texts, with boxes in 64 bits, a known form and no size of 0.

    Arrays without nulls are only cast, which Spark compiles; reading them twice also keeps whatever builds them out of the interpreted lambda."""
    kinds, out = {f.name: f.dataType for f in pages.schema}, {}
    wide = lambda f: isinstance(f.dataType, T.IntegralType) and not f.name.endswith("_no")

    def field(f: T.StructField) -> str:
        value = f"e.`{f.name}`"
        if isinstance(f.dataType, T.StringType):
            value = f"coalesce({value}, '')"
        elif wide(f):
            value = f"CAST({value} AS BIGINT)"
        return f"'{f.name}', {value}"

    for name in ("lines", "cells", "seals", "segments"):
        if isinstance(kind := kinds.get(name), T.ArrayType) and isinstance(kind.elementType, T.StructType):
            fields = kind.elementType.fields
            texts = [f"e.`{f.name}` IS NULL" for f in fields if isinstance(f.dataType, T.StringType)]
            mended = F.expr(f"transform(filter({name}, e -> e IS NOT NULL), e -> named_struct({', '.join(map(field, fields))}))")
            plain = F.col(name).cast(T.ArrayType(T.StructType([T.StructField(f.name, T.LongType() if wide(f) else f.dataType) for f in fields])))
            out[name] = F.when(F.expr(f"exists({name}, e -> {' OR '.join(['e IS NULL', *texts])})"), mended).otherwise(plain)
    if "form_type" in kinds:
        out["form_type"] = F.coalesce("form_type", F.lit(c.UNKNOWN_FORM))
    return pages.withColumns(out | {name: F.expr(f"nullif(CAST({name} AS BIGINT), 0)") for name in ("width", "height") if name in kinds})


def prepared(pages: DataFrame, book: dict | None = None) -> DataFrame:
    """pages, made sound, with every helper whose arrays are there."""
    have, pages = set(pages.columns), sound(pages)
    if "lines" in have:
        pages = pages.withColumn("bare_text", F.expr(t.bare("array_join(lines.text, '\\n')")))
    return pages.withColumns({name: F.expr(sql) for name, (sql, needs) in helpers(book or c.BOOK).items() if have.issuperset(needs)})


def _a01(p: dict) -> PerLine:
    """Months of 1 to 12 and days of 1 to 31, full-width digits included, but for eight digits with points."""
    real = f"rlike({t.plain_digits('m')}, {t.pattern(r'^.{4}[./-](?:0?[1-9]|1[0-2])[./-](?:0?[1-9]|[12][0-9]|3[01])$')})"
    keep = f"{real} AND NOT rlike(m, {t.pattern(r'^.{4}[.]\d{2}[.]\d{2}$')})"
    preprinted = " AND ".join(f"contains(l.text, {t.quoted(x)})" for x in p["skip_if_contains"])
    dated = f"{_one_of('l.text', ('19', '20'))} AND {_one_of('l.text', './-')}"  # what DATE spells out, so that few lines are searched
    return per_match(DATE, 0.85, keep, f"{dated}{f' AND NOT ({preprinted})' if preprinted else ''}")


def _a02(p: dict) -> PerLine:
    """Ranges with a unit, and diameters, whose sign no other range begins with."""
    unit = "|".join(sorted(p["units"], key=len, reverse=True))
    ranges = matches(rf"(?<![\d\-]){t.NUM}\s*(?:{unit})?\s*[{t.DASHES}]\s*{t.NUM}\s*(?:{unit})?", f"rlike(m, {t.pattern(unit)})")
    diameters = matches(rf"Φ\s*{t.NUM}\s*[{t.DASHES}]\s*Φ?\s*{t.NUM}")
    return PerLine(_one_of("l.text", tuple(t.DASHES)), f"concat({ranges}, if(contains(l.text, 'Φ'), {diameters}, CAST(array() AS array<string>)))", 0.9)


def _a06(p: dict) -> PerLine:
    hit = lambda u: f"if(contains(l.text, '{u}') AND rlike(l.text, {t.pattern(rf'{chr(92)}d{chr(92)}s*{u}(?![a-zA-Z])')}), '{u}', NULL)"
    return PerLine(_one_of("l.text", p["wrong_to_right"]), f"filter(array({', '.join(map(hit, p['wrong_to_right']))}), u -> u IS NOT NULL)", 0.8)


def _a09(p: dict) -> str:
    """Fine with a total of one page or with both numbers (in this order, if asked for); else the first half a number, else nothing of the kind."""
    total, current = t.pattern(r"共\s*(\d+)\s*页"), t.pattern(r"第\s*\d+\s*页")
    ordered = f" AND rlike(l.text, {t.pattern(r'第\s*\d+\s*页\s*[，,、 ]?\s*共\s*\d+\s*页')})" if p["strict_order"] else ""
    said = f"exists(lines, l -> contains(l.text, '页') AND rlike(l.text, {total}) AND ({t.number(f'regexp_extract(l.text, {total}, 1)')} <= 1 OR rlike(l.text, {current}){ordered}))"
    loose = f"filter(lines, l -> contains(l.text, '页') AND (rlike(l.text, {total}) OR rlike(l.text, {current})))"
    wanted = f"page_count >= {int(p['min_pages'])} AND NOT ({BLANK}) AND NOT {said}"
    half = page_finding(f"{wanted} AND size({loose}) > 0", 0.6, g.first(loose))
    return f"concat({half}, {page_finding(f'{wanted} AND size({loose}) = 0', 0.5)})" if p["flag_missing"] else half


def _a10(p: dict) -> PerLine:
    """Numbers that are part of an identifier don't count: two points, a letter before, or a tail that is no unit."""
    token = rf"([A-Za-z0-9._\-/]*?)(\d+\.\d{{{int(p['max_decimals']) + 1},}})([A-Za-z0-9._\-/]*)"
    part = lambda i: f"regexp_extract(m, {t.pattern(token)}, {i})"
    units = "('', 'mm', 'kg', 'g', 'm', 'km', 'mpa', '℃', '%', 'hrc', 'hbw', 'hb', 's', 'h', 'min', 'n', 'kn', 't', 'pa', 'l')"
    keep = f"length(m) - length(replace(m, '.', '')) < 2 AND NOT rlike({part(1)}, '[A-Za-z]') AND {t.plain_lower(part(3))} IN {units}"
    searched = f"contains(l.text, '.') AND rlike(l.text, {t.pattern(rf'[.]{chr(92)}d{{{int(p['max_decimals']) + 1},}}')})"  # token tries every start of a line
    return per_match(token, 0.7, keep, searched, page=_any("page_text", p["require_keywords"]) if p["require_keywords"] else "true")


def _a11(p: dict) -> PerLine:
    pat = rf"\(\s*-\s*({t.NUM})\s*[{t.WAVES}]\s*\+?\s*({t.NUM})\s*\)"
    n = lambda i: t.number(f"regexp_extract(m, {t.pattern(pat)}, {i})", "DOUBLE")
    return per_match(pat, 0.8, f"abs({n(1)} - {n(2)}) < 1e-9D", words=("(",))


def _a12(p: dict) -> str:
    anchor = g.first("filter(lines, l -> contains(l.text, '特殊记载'))")
    filled = f"exists(lines, v -> v.line_no <> a.line_no AND {g.cy('v')} BETWEEN a.y - a.h AND a.y + 4 * a.h AND {g.cx('v')} > {g.cx('a')})"
    return f"transform(filter(array({anchor}), a -> a IS NOT NULL AND NOT contains(replace(a.text, '特殊记载', ''), '无') AND NOT {filled}), a -> {finding('a.line_no', 'a.text', 'NULL', 0.55)})"


def _a13(p: dict) -> PerLine:
    known = _any(t.bare("l.text"), p["known_variants"])
    return per_line(f"contains({t.bare('l.text')}, '与原件') AND NOT contains({t.bare('l.text')}, {t.quoted(p['required_text'])})", "NULL", f"if({known}, 0.9D, 0.6D)")


def _a14(p: dict) -> str:
    inside = f"l.line_no <> result_column.hdr.line_no AND {g.cy('l')} > {g.cy('result_column.hdr')} AND {g.cx('l')} BETWEEN result_column.x1 AND result_column.x2"
    kind = lambda k: f"filter(lines, l -> {inside} AND {t.value_kind('l.text')} = '{k}')"
    return page_finding(f"result_column IS NOT NULL AND size({kind('verdict')}) > 0 AND size({kind('measured')}) > 0", 0.6, g.first(kind("verdict")))


def _a15(p: dict) -> str:
    near = f"filter(lines, v -> {g.cx('v')} BETWEEN actual_column.x1 AND actual_column.x2 AND abs({g.cy('v')} - {g.cy('a')}) <= greatest(a.h, 20) * {float(p['row_band_factor'])}D AND rlike({t.bare('v.text')}, {t.pattern('^' + t.NUM + '$')}))"
    anchors = f"filter(lines, a -> actual_column IS NOT NULL AND {_any('a.text', p['keywords'])} AND {g.cy('a')} > {g.cy('actual_column.hdr')})"
    return f"flatten(transform({anchors}, a -> transform({near}, v -> {finding('v.line_no', 'v.text', 'a.text', 0.6)})))"


def _a16(p: dict) -> str:
    pat = r"[（(](\d{1,2})\s*处[)）]|(?<![\d.])(\d{1,2})\s*-\s*[ΦR]|测量\s*(\d{1,2})\s*点"
    n = lambda x: "coalesce(" + ", ".join(t.number(f"regexp_extract({x}.text, {t.pattern(pat)}, {i})") for i in (1, 2, 3)) + ")"
    said = f"exists(array({n('a')}), n -> n BETWEEN 2 AND {int(p['max_listed'])})"  # read once: BETWEEN would read it twice
    anchors = f"filter(lines, a -> listed_column IS NOT NULL AND {_one_of('a.text', ('处', 'Φ', 'R', '测量'))} AND {g.cy('a')} > {g.cy('listed_column.hdr')} AND {g.cx('a')} < listed_column.x1 AND {said})"
    values = f"filter(transform({anchors}, a -> {band_value('a', 'listed_column')}), v -> rlike(v.text, '[～~]'))"
    return f"transform({values}, v -> {finding('v.line_no', 'v.text', 'NULL', 0.6)})"


def _a17(p: dict) -> str:
    specs = f"filter(lines, a -> spec_column IS NOT NULL AND measured_column IS NOT NULL AND {g.cy('a')} > {g.cy('spec_column.hdr')} AND {g.cx('a')} BETWEEN spec_column.x1 AND spec_column.x2 AND {t.decimals('a.text')} > 0)"
    pairs = f"transform({specs}, a -> named_struct('want', {t.decimals('a.text')}, 'v', {band_value('a', 'measured_column')}))"
    short = f"filter({pairs}, p -> {t.decimals('p.v.text')} > 0 AND {t.decimals('p.v.text')} < p.want)"
    return f"transform({short}, p -> {finding('p.v.line_no', 'p.v.text', 'p.want', 0.55)})"


def _a18(p: dict) -> str:
    labels = p["labels"]
    anchor = g.first(f"filter(lines, l -> {_any(t.bare('l.text'), labels)})")
    band = "greatest(a.h, 20) * 1.4D"
    clean = f"regexp_replace(v.text, {t.pattern('[' + chr(92) + 's:：]')}, '')"
    signed = f"exists(lines, v -> v.line_no <> a.line_no AND abs({g.cy('v')} - {g.cy('a')}) <= {band} AND {g.cx('v')} > {g.cx('a')} AND {clean} <> '' AND NOT {_any(clean, labels)})"
    stamped = f"exists(seals, s -> {g.cx('s')} > a.x AND abs({g.cy('s')} - {g.cy('a')}) <= {band})"
    found = f"transform(filter(array({anchor}), a -> a IS NOT NULL AND {COPY} AND NOT {signed} AND NOT {stamped}), a -> {finding('a.line_no', 'a.text', 'NULL', 0.5)})"
    return f"concat({found}, {page_finding(f'{COPY} AND {anchor} IS NULL', 0.35)})" if p["flag_missing_field"] else found


def _b02(p: dict) -> str:
    big = f"filter(seals, s -> s.fill >= 0.18D AND s.area >= {float(p['min_seal_area_ratio'])}D * width * height)"
    cover = f"greatest({g.overlap('s', 'o')}, {g.overlap('o', 's')})"
    return f"flatten(transform({big}, s -> transform(filter({big}, o -> o.seal_no > s.seal_no AND {cover} >= {float(p['min_coverage'])}D), o -> {finding('s.seal_no', 'NULL', 'o.seal_no', 0.7, around('array(s, o)'))})))"


def _b03(p: dict) -> str:
    dated = f"filter(lines, l -> rlike(l.text, {t.pattern(ANY_DATE)}) AND {RED_LINE} <= 0.02D)"
    return f"flatten(transform({dated}, l -> transform(filter({STAMPS}, s -> {g.overlap('l', 's')} >= {float(p['min_overlap_ratio'])}D), s -> {finding('s.seal_no', 'l.text', 'l.line_no', 0.65)})))"


def _b04(p: dict) -> str:
    """Blank registered cells by name: a group of them is one finding, else one each."""
    many_from, fields = int(p["group_as_column"]), () if p["check_all_fields"] else p["field_whitelist"]
    area = "k.w * k.h / CAST(width * height AS DOUBLE)"
    blank = f"filter(cells, k -> {area} BETWEEN {float(p['min_cell_area_ratio'])}D AND {float(p['max_cell_area_ratio'])}D AND trim(k.content) = '' AND k.ink <= 0.004D AND NOT exists(seals, s -> {g.overlap('k', 's')} > 0.15D))"
    named = f"transform({blank}, b -> named_struct('b', b, 'up', coalesce(left({above('b')}.content, 14), ''), 'side', coalesce(left({beside('b')}.content, 14), '')))"
    known = f" AND {_any('if(x.up <> ' + chr(39) * 2 + ', x.up, x.side)', fields)}" if fields else ""
    kept = f"filter({named}, x -> NOT {_any('x.up', p['downstream_whitelist'])} AND NOT {_any('x.side', p['downstream_whitelist'])}{known})"
    cells = f"transform({kept}, x -> named_struct('no', x.b.cell_no, 'b', x.b, 'name', if(x.up <> '', x.up, x.side)))"
    single = f"transform(filter(xs, x -> size(filter(xs, y -> y.name = x.name)) < {many_from}), x -> {finding('x.no', 'x.name', '1', 0.4)})"
    many = f"transform(filter(array_distinct(transform(xs, x -> x.name)), n -> size(filter(xs, y -> y.name = n)) >= {many_from}), n -> {finding('NULL', 'n', 'size(filter(xs, y -> y.name = n))', 0.5, around('transform(filter(xs, y -> y.name = n), y -> y.b)'))})"
    return f"transform(array({cells}), xs -> concat({single}, {many}))[0]"


def _b06(p: dict) -> str:
    # lines and a stroke's height are worked out once, not for each pair; heights part most pairs, so they come first
    rows = "transform(filter(lines, l -> l.h >= 8 AND l.w >= 30), l -> named_struct('top', l.y + l.h * 0.2D, 'low', l.y + l.h * 0.8D, 'x', l.x, 'w', l.w, 'h', l.h))"
    struck = f"exists(ls, l -> s.at >= l.top AND s.at <= l.low AND s.w >= l.h * 2 AND {g.shared_x('s', 'l')} > 0 AND {g.shared_x('s', 'l')} >= 0.5D * l.w AND s.w <= l.w * 1.3D)"
    flat = "transform(filter(segments, s -> s.w >= 40 AND s.w / CAST(greatest(s.h, 1) AS DOUBLE) >= 8), s -> named_struct('at', s.y + s.h / 2D, 'x', s.x, 'y', s.y, 'w', s.w, 'h', s.h))"
    hits = f"transform(array({rows}), ls -> filter({flat}, s -> {struck}))[0]"
    return f"transform(filter(array({hits}), xs -> size(xs) > {int(p['max_per_page'])}), xs -> {finding('NULL', 'NULL', 'size(xs)', 0.4, around('xs'))})"


def _b07(p: dict) -> str:
    h, col = "inspector_column.hdr", "inspector_column"
    seen = f"exists({STAMPS}, s -> {g.cx('s')} BETWEEN {col}.x1 AND {col}.x2 AND {g.cy('s')} > {g.cy(h)} OR {g.cx('s')} > {g.cx(h)} AND {g.cy('s')} BETWEEN {g.cy(h)} - greatest({h}.h, 20) * 1.2D AND {g.cy(h)} + greatest({h}.h, 20) * 1.6D)"
    waiting = f"size(filter(lines, l -> {g.cy('l')} > {g.cy(h)} + {h}.h AND {g.cx('l')} < {col}.x1)) >= 2"
    copied, least = f" AND NOT {COPY}" if p["skip_copy_pages"] else "", f"{float(p['region_red_ratio'])}D"
    return page_finding(f"{col} IS NOT NULL{copied} AND NOT ({BLANK}) AND NOT {seen} AND {COLUMN_RED} <= {least} AND {ROW_RED} <= {least} AND {waiting}", 0.5, h, box(f"{col}.x1", g.cy(h), f"greatest(10, {col}.x2 - {col}.x1)", f"floor((height - {g.cy(h)}) / 3)"))


def _b09(p: dict) -> str:
    numbered = g.first(f"filter(lines, l -> contains(l.text, '页') AND rlike(l.text, {t.pattern('第' + chr(92) + 's*' + chr(92) + 'd+' + chr(92) + 's*页|共' + chr(92) + 's*' + chr(92) + 'd+' + chr(92) + 's*页')}))")
    fine = f"{g.cy('l')} / height >= {float(p['footer_from'])}D AND {g.cx('l')} / width BETWEEN {float(p['center_from'])}D AND {float(p['center_to'])}D"
    return f"transform(filter(array({numbered}), l -> l IS NOT NULL AND NOT ({fine})), l -> {finding('l.line_no', 'l.text', 'NULL', 0.6)})"


def _f01(p: dict) -> str:
    anchor = label_cell("'装配处'")
    value = f"transform(filter(array({anchor}), a -> a IS NOT NULL), a -> {value_cell('a')})"
    return f"transform(filter({value}, v -> {t.bare('v.content')} IN ('/', '／', {t.quoted(chr(92))})), v -> {finding('v.cell_no', 'v.content', 'NULL', 0.8)})"


def _f08(p: dict) -> str:
    hard = f"filter(lines, l -> contains(l.text, 'H') AND rlike(l.text, {t.pattern(chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?' + chr(92) + 's*(HRC|HBW|HRB|HB|HV)')}))"
    sampled = "contains(page_text, '抽检')"
    ok = f"(exists({hard}, l -> rlike(l.text, '[～~]')) AND NOT {sampled} OR {sampled} AND rlike(page_text, {t.pattern('抽检' + chr(92) + 's*' + chr(92) + 'd+')}))"
    return page_finding(f"size({hard}) > 0 AND NOT {ok}", 0.45, g.first(hard))


def _f09(p: dict) -> str:
    one = lambda f: f"transform(filter(array({label_cell(t.quoted(f))}), a -> a IS NOT NULL AND trim(coalesce({value_cell('a')}.content, '')) = ''), a -> {finding(f'coalesce({value_cell(chr(97))}.cell_no, a.cell_no)', t.quoted(f), 'NULL', 0.6)})"
    return f"concat({', '.join(map(one, p['required_fields']))})"


_BOTTOM = f"array_join(transform(filter(lines, l -> {g.cy('l')} > height * 0.62D), l -> l.text), '')"
_HAS = lambda words: f"exists(lines, l -> {_one_of('l.text', words) if words else 'false'})"
_FIRST = lambda words: g.first(f"filter(lines, l -> {_one_of('l.text', words) if words else 'false'})")

def _b01(p: dict) -> str:
    return f"transform(filter({STAMPS}, s -> s.rect >= 0.8D AND abs(s.angle) > {float(p['max_tilt_deg'])}D), s -> {finding('s.seal_no', 'NULL', 's.angle', 0.6)})"


def _b05(p: dict) -> PerLine:
    there = f"{g.cx('l')} / width >= {float(p['right_bottom_x'])}D AND {g.cy('l')} / height >= {float(p['right_bottom_y'])}D"
    return per_line(f"contains({t.bare('l.text')}, '与原件') AND NOT ({there})", "NULL", 0.75)


def _b08(p: dict) -> str:
    copied = f" AND NOT {COPY}" if p["skip_copy_pages"] else ""
    return page_finding(f"NOT ({BLANK}){copied} AND red_ratio < {float(p['min_red_pixel_ratio'])}D", 0.7)


def _f06(p: dict) -> str:
    lacking = f"array_join(filter(array({_in(p['required_fields'])}), k -> NOT contains(page_text, k)), '、')"
    return f"if(page_no = 1 AND NOT ({BLANK}), transform(filter(array({lacking}), d -> d <> ''), d -> {finding('NULL', 'NULL', 'd', 0.55)}), {NONE})"


#: Rule -> a function of its parameters (the catalog's, as packs and overrides changed them) that gives its SQL or PerLine.
BUILDERS = {
    "A01": _a01,
    "A02": _a02,
    "A03": lambda p: per_line(_one_of("l.text", p["forbidden"]) if p["forbidden"] else "false", f"array_join(filter(array({_in(p['forbidden'])}), k -> contains(l.text, k)), '、')", 0.7),
    "A04": lambda p: per_match(rf"Φ\s*{t.NUM}\s*[{t.WAVES}]\s*(?!Φ){t.NUM}", 0.85, words=("Φ",)),
    "A05": lambda p: per_match(rf"{t.NUM}\s*mm(?![a-zA-Z/])", 0.6, words=("mm",)),
    "A06": _a06,
    "A07": lambda p: per_match(r"m\s*[23²³](?![0-9])", 0.6, words=("m",)),
    "A08": lambda p: per_match(r"[零一二三四五六七八九十百千两]{1,6}\s*(?:公斤|千克|摄氏度|毫米|厘米|米|吨|克)", 0.7, words=("斤", "克", "度", "米", "吨")),
    "A09": _a09,
    "A10": _a10,
    "A11": _a11,
    "A12": _a12,
    "A13": _a13,
    "A14": _a14,
    "A15": _a15,
    "A16": _a16,
    "A17": _a17,
    "A18": _a18,
    "B01": _b01,
    "B02": _b02,
    "B03": _b03,
    "B04": _b04,
    "B05": _b05,
    "B06": _b06,
    "B07": _b07,
    "B08": _b08,
    "B09": _b09,
    "B10": lambda p: page_finding(f"NOT ({BLANK}) AND blue_ratio >= {float(p['min_blue_ratio'])}D", 0.5),
    "F01": _f01,
    "F02": lambda p: page_finding(f"NOT ({BLANK}) AND NOT contains(page_text, '设计图版次') AND NOT contains(page_text, '图纸版次')", 0.5),
    "F03": lambda p: page_finding(f"{_HAS(('呈报',))} AND NOT rlike(page_text, {t.pattern('共' + chr(92) + 's*' + chr(92) + 'd+' + chr(92) + 's*页')})", 0.6, _FIRST(("呈报",))),
    "F04": lambda p: page_finding(f"NOT ({BLANK}) AND red_ratio < {float(p['min_red_pixel_ratio'])}D", 0.7),
    "F05": lambda p: page_finding(f"{_HAS(p['trigger_keywords'])} AND NOT {_any('page_text', p['closure_keywords'])}", 0.5, _FIRST(p["trigger_keywords"])),
    "F06": _f06,
    "F07": lambda p: page_finding(f"{_HAS(p['trigger_keywords'])} AND NOT contains(page_text, '拒收单')", 0.5, _FIRST(p["trigger_keywords"])),
    "F08": _f08,
    "F09": _f09,
    "F10": lambda p: page_finding(f"NOT ({BLANK}) AND NOT {_any(_BOTTOM, p['keywords'])}", 0.5),
    "F11": lambda p: page_finding(f"NOT ({BLANK}) AND NOT rlike({_BOTTOM}, {t.pattern(BATCH)}) AND NOT contains({_BOTTOM}, '不涉及呈报')", 0.45),
    "F12": lambda p: page_finding(f"{_HAS(('呈报',))} AND NOT contains(page_text, '闭环') AND NOT contains(page_text, '不涉及呈报')", 0.5, _FIRST(("呈报",))),
}
#: The rules with the catalog's own parameters.
RULES = {r: array_sql(build(c.BOOK[r].params)) for r, build in BUILDERS.items()}
#: What a rule reads besides the page's own columns; seals and cells may be missing from a catalog run on text alone.
ARRAYS = {r: tuple(a for a in ("lines", "cells", "seals", "segments") if a in sql or a in ("lines", "cells") and "_column" in sql) for r, sql in RULES.items()}


#: What else a page may lack that a rule reads.
MEASURES = ("width", "height", "red_ratio", "blue_ratio", "page_no", "page_count")


def _lacking(rule: str, sql: str, have: set[str]) -> str:
    """SQL: whether the page lacks something that the rule reads."""
    read = [*ARRAYS[rule], *(m for m in MEASURES if re.search(rf"(?<![\w.]){m}\b", sql))]
    return " OR ".join(f"{x} IS NULL" for x in read if x in have) or "false"


def _for(pages: DataFrame, sql: str) -> str:
    """A rule's SQL with the red shares that the pages have."""
    red = {RED_LINE: "0D", COLUMN_RED: "red_ratio", ROW_RED: "red_ratio"}
    if "lines" in pages.columns and "red_ratio" in pages.schema["lines"].dataType.elementType.names:
        red[RED_LINE] = "coalesce(l.red_ratio, 0D)"
    red |= {mark: f"coalesce({name}, red_ratio)" for mark, name in ((COLUMN_RED, "column_red"), (ROW_RED, "row_red")) if name in pages.columns}
    for mark, column_ in red.items():
        sql = sql.replace(mark, column_)
    return sql


def _plain(lines: T.ArrayType) -> str:
    """SQL: whether no two lines of a page have the same number or box, as findings give them, and each has a number. lines: their type before sound()."""
    kinds = {f.name: f.dataType for f in lines.elementType.fields}
    value = lambda f: f"l.{f}" if isinstance(kinds.get(f), T.IntegerType) else f"try_cast(l.{f} AS INT)"
    numbers = "lines.line_no" if isinstance(kinds.get("line_no"), T.IntegerType) else f"transform(lines, l -> {value('line_no')})"
    alike = f"transform(lines, l -> xxhash64({', '.join(map(value, 'xywh'))}))"
    return f"size(array_distinct({numbers})) = size(lines) AND NOT exists({numbers}, n -> n IS NULL) AND size(array_distinct({alike})) = size(lines)"


def told(pages: DataFrame, *ids: str, book: dict | None = None, boxes: str | None = None) -> DataFrame:
    """doc_id, page_no, rule_id, no, evidence, detail, confidence of the rules: all enabled ones whose arrays are there, or those named, even if they are switched off.

    boxes, SQL for the box of a finding e that has a rule_id and the rule's own f, adds box, and of a page's findings with equal rule, detail and box only the first stays.
    A rule whose SQL the pages don't fit (a parameter of a wrong kind, a column of another type) is left out with a warning; the others run."""
    book, have = book or c.BOOK, set(pages.columns)
    chosen = ids or [r for r in BUILDERS if r in book and book[r].enabled and have.issuperset(ARRAYS[r])]
    none = f"CAST(array() AS array<struct<rule_id:string,f:{FINDING}>>)"
    ready, each, by_line = prepared(pages, book), {}, {}
    if boxes and "lines" in have:
        ready = ready.withColumn("_plain", F.expr(f"coalesce({_plain(pages.schema['lines'].dataType)}, false)"))
    for r in chosen:
        try:
            built = BUILDERS[r](book[r].params)
            sql, applies = _for(pages, array_sql(built)), book[r].applies()
            lacking = _lacking(r, sql, have)
            failed = f"array({finding('NULL', 'NULL', t.quoted(FAILED), 0.0)})"
            if isinstance(built, PerLine) and "lines" in have:
                # lines that can't be told apart lose their repeats within the page
                by_line[r] = built, f"coalesce(({applies}) AND NOT ({lacking}) AND {'_plain' if boxes else 'true'} AND ({built.page}), false)"
                sql, applies = sql if boxes else NONE, f"({applies}) AND (({lacking}){' OR NOT _plain' if boxes else ''})"
            each[r] = f"if({applies}, transform(if({lacking}, {failed}, coalesce({sql}, {failed})), f -> named_struct('rule_id', '{r}', 'f', f)), {none})"
        except (KeyError, TypeError, ValueError) as e:
            _left_out(r, e)
    try:
        return _rows(ready, each, by_line, none, boxes)
    except AnalysisException:
        for r in list(each):
            try:
                _rows(ready, {r: each[r]}, {r: by_line[r]} if r in by_line else {}, none, boxes)
            except AnalysisException as e:
                _left_out(r, e)
                del each[r]
                by_line.pop(r, None)
        return _rows(ready, each, by_line, none, boxes)


def _rows(ready: DataFrame, each: dict[str, str], by_line: dict[str, tuple[PerLine, str]], none: str, boxes: str | None) -> DataFrame:
    """The findings of told(): each: rule -> SQL over the page; by_line: rule -> its PerLine and, as SQL, the pages that it is compiled on."""
    shaped = lambda fields: f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in fields.items())})"
    own = {"rule_id": "e.rule_id", "no": "e.f.no", "evidence": "e.f.evidence", "confidence": "e.f.confidence"} | ({"box": boxes} if boxes else {}) | {"details": "array(e.f.detail)"}
    key = lambda x: f"struct({x}.rule_id, {x}.details, {x}.confidence = 0 AND {x}.details[0] <=> {t.quoted(FAILED)}, {x}.box)"
    once = f"if(size(found) < 2, found, transform(array(transform(found, y -> {key('y')})), ks -> filter(found, (x, i) -> array_position(ks, ks[i]) = i + 1))[0])"  # keys once a page, not once a finding
    # arrays read twice stay columns of their own: merged into a lambda's projection, whatever makes them would be interpreted.
    # explode() would put a filter on an array's size beneath whatever makes the array, which would be worked out twice; explode_outer() doesn't
    pages = ready.withColumn("findings", F.expr(f"concat({', '.join([none, *each.values()])})"))
    pages = pages.withColumn("found", F.expr(f"if(size(findings) = 0, CAST(array() AS {_HITS(boxes)}), transform(findings, e -> {shaped(own)}))"))
    if boxes:
        pages = pages.withColumn("found", F.expr(once))
    if by_line:
        gates = [F.expr(on).alias(f"_on_{r}") for r, (_, on) in by_line.items()]
        # the page's own findings go with a null behind the lines
        lines = pages.select("doc_id", "page_no", *[m for m in MEASURES if m in pages.columns and m != "page_no"], "found", *gates, F.expr("concat(coalesce(lines, array()), array(NULL))").alias("_lines"))
        lines = lines.select(*[x for x in lines.columns if x != "_lines"], F.explode_outer("_lines").alias("l"))
        hits = []
        for r, (rule, _) in by_line.items():
            conf = rule.confidence if isinstance(rule.confidence, str) else f"{rule.confidence}D"
            at = {"rule_id": f"'{r}'", "no": "try_cast(l.line_no AS INT)", "evidence": "CAST(l.text AS STRING)", "confidence": conf} | ({"box": box(*(f"l.{f}" for f in "xywh"))} if boxes else {})
            hits.append(f"if(_on_{r} AND ({rule.when}), {shaped(at | {'details': f'array_distinct({rule.details})' if boxes else rule.details})}, NULL)")
        pages = lines.withColumn("found", F.expr(f"if(l IS NULL, found, array({', '.join(hits)}))"))
    flat = pages.select("doc_id", "page_no", F.explode_outer("found").alias("x"))
    return flat.select("doc_id", "page_no", "x", F.explode("x.details").alias("detail")).select("doc_id", "page_no", "x.rule_id", "x.no", "x.evidence", "detail", "x.confidence", *(["x.box"] if boxes else []))


_HITS = lambda boxes: f"array<struct<rule_id:string,no:int,evidence:string,confidence:double,{f'box:{BOX},' if boxes else ''}details:array<string>>>"


def _left_out(rule: str, why: Exception) -> None:
    warnings.warn(f"{rule} is left out: {str(why).splitlines()[0]}", stacklevel=4)


def findings(pages: DataFrame, *ids: str, book: dict | None = None) -> DataFrame:
    """doc_id, page_no, rule_id, no, evidence, detail, confidence of the rules (all enabled ones whose arrays are there).

    Rules named explicitly run even if the catalog has them switched off."""
    return told(pages, *ids, book=book)
