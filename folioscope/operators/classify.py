"""What a page says of itself: form, page marker, key fields, title."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..plans.catalog import UNKNOWN_FORM
from .page_rules import finding, label_cell, value_cell  # noqa: F401

#: The fields whose value tells one document from another.
KEY_FIELDS = ("零件号", "零件件号", "零（组）件号", "零件图号", "图号", "批次顺序号", "批次号", "型别")
#: Each of them holds one of these.
KEY_SIGNS = ("号", "型别")
TITLE = "证明单|流水卡片|配套单|装配信息单|检验记录|报告单|通知单|合格证|检查表"


@dataclass(frozen=True)
class Forms:
    """Ordered keyword patterns and structural sets: the head of the page first, then the page, then all words of a set. A supplier's pattern stands before all others."""

    patterns: tuple[tuple[str, tuple[str, ...]], ...]
    structural: tuple[tuple[str, tuple[str, ...]], ...] = ()
    internal: frozenset[str] = frozenset()
    supplier: frozenset[str] = frozenset()

    def merged(self, *packs: Forms) -> Forms:
        """Packs' patterns come before the defaults, but for the supplier's; a default that a pack names again gives way. Internal forms add up; packs that name supplier forms replace them."""
        lead = tuple(x for x in self.patterns[:1] if x[0] == SUPPLIER_PATTERN[0])
        added = [x for pack in packs for x in pack.patterns]
        names = {n for n, _ in added}
        tail = (x for x in self.patterns[len(lead) :] if x[0] not in names)
        sets = [x for pack in packs for x in pack.structural]
        named = frozenset().union(*(pack.supplier for pack in packs))
        return Forms((*lead, *added, *tail), (*sets, *self.structural), self.internal.union(*(pack.internal for pack in packs)), named or self.supplier)

    def known(self) -> list[str]:
        """All forms that can be recognised, in order."""
        return list(dict.fromkeys(n for n, _ in (*self.patterns, *self.structural)))

    def sql(self, lines: str = "lines", height: str = "height") -> str:
        """Words may run over lines: the texts are joined first."""
        joined = lambda rows: f"array_join(transform({rows}, l -> l.text), '')"
        has = lambda text, word: f"contains({text}, {t.quoted(word)})"
        cases = [f"WHEN {' OR '.join(has(scope, w) for w in words)} THEN {t.quoted(name)}" for scope in ("x.head", "x.page") for name, words in self.patterns]
        cases += [f"WHEN {' AND '.join(has('x.page', w) for w in words)} THEN {t.quoted(name)}" for name, words in self.structural]
        head = joined(f"filter({lines}, l -> {g.cy('l')} < {height} * 0.34D)")
        return f"transform(array(named_struct('head', {head}, 'page', {joined(lines)})), x -> CASE {' '.join(cases)} ELSE '{UNKNOWN_FORM}' END)[0]"

    def is_internal(self, form: str = "form_type") -> str:
        """SQL: whether a form is one of the house."""
        return f"{form} IN ({', '.join(map(t.quoted, sorted(self.internal)))})" if self.internal else "false"


#: The names by which suppliers' certificates are known, and the forms that every catalog knows.
SUPPLIER_PATTERN = ("供方合格证", ("产品质量证明书", "技术质量证明书", "质量证明书", "材质证明书", "合格证明书", "Certificate of Quality", "Quality Certification"))
DEFAULT = Forms(
    (
        SUPPLIER_PATTERN,
        ("卷宗目录", ("卷宗表格目录", "卷宗目录", "表格目录")),
        ("检验记录", ("成品检验记录", "工序检验记录", "检验记录", "复验记录", "试验记录")),
        ("产品合格证", ("产品合格证",)),
    ),
    (("检验记录", ("规定", "实际", "检验员")),),
    frozenset({"检验记录"}),
    frozenset({"供方合格证", "产品合格证"}),
)


def forms_of(spec: dict) -> Forms:
    """A pack's `forms`: patterns (form, keywords), structural (all, form), internal, supplier."""
    words = lambda xs: tuple(str(x) for x in xs or () if str(x).strip())
    patterns = tuple((str(x.get("form") or "").strip(), words(x.get("keywords"))) for x in spec.get("patterns") or ())
    sets = tuple((str(x.get("form") or "").strip(), words(x.get("all"))) for x in spec.get("structural") or ())
    return Forms(tuple(x for x in patterns if all(x)), tuple(x for x in sets if all(x)), frozenset(words(spec.get("internal"))), frozenset(words(spec.get("supplier"))))


def _marker_of(text: str) -> str:
    number = lambda p, i: t.number(f"regexp_extract({text}, {t.pattern(p)}, {i})")
    cur, total = number(r"第\s*(\d+)\s*页", 1), number(r"共\s*(\d+)\s*页", 1)
    slash = r"(?<!\d)(\d{1,3})\s*/\s*(\d{1,3})\s*页"
    a, b = number(slash, 1), number(slash, 2)
    pair = lambda x, y: f"named_struct('current', {x}, 'total', {y})"
    # each pair is read once and only where its signs are
    both = f"filter(array(if(contains({text}, '第') AND contains({text}, '共'), {pair(cur, total)}, NULL)), m -> m.current IS NOT NULL AND m.total IS NOT NULL)"
    slashed = f"filter(array(if(contains({text}, '/'), {pair(a, b)}, NULL)), m -> m.current BETWEEN 1 AND m.total)"
    return f"coalesce(get({both}, 0), get({slashed}, 0))"


def marker(lines: str, page_text: str) -> str:
    """SQL for (current, total): the first line that tells both, else the page's text. Every form of it holds 页, which spares most lines the expressions."""
    told = f"get(filter(transform(filter({lines}, l -> contains(l.text, '页')), l -> {_marker_of('l.text')}), m -> m IS NOT NULL), 0)"
    return f"coalesce({told}, if(contains({page_text}, '页'), {_marker_of(page_text)}, NULL))"


def known(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the column `name`, SQL for a value, where it isn't null. A filter would be pushed down and work the value out a second time, generators aren't."""
    return df.select("*", F.explode(F.expr(f"filter(array({value}), v -> v IS NOT NULL)")).alias(name))


def keys() -> str:
    """SQL for the map of key fields: the cell beside a label, else what follows the field's name in the text."""
    clean = lambda v: f"substring(regexp_replace({v}, {t.pattern(chr(92) + 's+')}, ''), 1, 30)"

    def one(field: str) -> str:
        f = t.quoted(field)
        anchor = f"get(filter(labels, k -> {t.bare('k.content')} = {f}), 0)"
        cell = f"get(transform(filter(array({anchor}), a -> a IS NOT NULL), a -> {value_cell('a')}.content), 0)"
        said = f"if(contains(page_text, {f}), regexp_extract(page_text, {t.pattern(field + '[:：' + chr(92) + 's]*([A-Za-z0-9][A-Za-z0-9./-]*)')}, 1), '')"
        return f"named_struct('key', {f}, 'value', get(filter(array({clean(cell)}, {clean(said)}), v -> v <> ''), 0))"

    # cells that are a field's name, looked for once; each value is read once, and only of fields that the page names
    labels = f"filter(cells, k -> {t.bare('k.content')} IN ({', '.join(map(t.quoted, KEY_FIELDS))}))"
    named = lambda field: f"if(exists(labels, k -> {t.bare('k.content')} = {t.quoted(field)}) OR said AND contains(page_text, {t.quoted(field)}), {one(field)}, NULL)"
    signs = " OR ".join(f"contains(page_text, {t.quoted(w)})" for w in KEY_SIGNS)
    entries = f"map_from_entries(filter(array({', '.join(map(named, KEY_FIELDS))}), e -> e.value IS NOT NULL))"
    return f"transform(array({labels}), labels -> transform(array({signs}), said -> {entries})[0])[0]"


def has_title(lines: str = "lines", height: str = "height") -> str:
    """SQL: a form's name in the top 30 % of the page."""
    top = f"array_join(filter({lines}, l -> {g.cy('l')} <= {height} * 0.3D).text, '')"
    return f"transform(array({top}), x -> {' OR '.join(f'contains(x, {t.quoted(w)})' for w in TITLE.split('|'))})[0]"


def digest() -> dict[str, str]:
    """Columns of page_digest from a prepared page row with lines, cells and page_text."""
    return {"keys": keys(), "marker": marker("lines", "page_text"), "has_title": has_title(), "text_len": "length(page_text)", "fingerprint": t.fingerprint("page_text")}
