"""The rule catalog: levels, gating and parameters; packs and overrides change it field by field."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
#: Form names that rules include or leave out, as they stand on scanned forms.
SUPPLIER = ("供方合格证", "产品合格证")
CONTENTS = (*SUPPLIER, "卷宗目录")
UNKNOWN_FORM = "未识别"


@dataclass(frozen=True)
class Rule:
    id: str
    level: str
    title: str
    enabled: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    clause: str = ""
    params: dict = field(default_factory=dict, hash=False)

    def applies(self, form: str = "form_type") -> str:
        """SQL: an excluded form never, else the included ones, else all."""
        names = lambda xs: ", ".join(f"'{x}'" for x in xs)
        out = [f"{form} NOT IN ({names(self.exclude)})"] if self.exclude else []
        out += [f"{form} IN ({names(self.include)})"] if self.include else []
        return " AND ".join(out) or "true"


#: Units and words of the rules.
UNITS = ("℃", "MPa", "mm", "kg", "HRC", "HRB", "HBW", "HB", "m3/h", "m³/h", "N", "kN", "g")
DIAMETERS = ("φ", "Ф", "ф", "∅", "ø", "Ø")
UNIT_CASE = {"Kg": "kg", "KG": "kg", "KM": "km", "Mm": "mm", "MM": "mm", "HZ": "Hz", "Mpa": "MPa", "MPA": "MPa"}
WEIGHING = ("称重", "重量", "净重", "毛重")
COPY_WORDING, COPY_VARIANTS = "此件与原件一致", ("复印件与原件一致", "与原件相符", "复印件与原件相符")
RESULT_HEADERS, ACTUAL_HEADERS, SPEC_HEADERS = ("实际", "实测值", "检验结论", "实 际"), ("实际", "实 际", "实测值"), ("规定", "规定值", "图纸规定")
QUANTITIES, REVIEWERS, INSPECTORS = ("流量", "泄漏率", "泄漏量", "扭矩", "压力"), ("复核人", "负责人", "审核人"), ("检验员", "检验", "质检")
DOWNSTREAM = ("操作者", "工人")
CELL_FIELDS = ("零件号", "批次号", "材料牌号", "规定", "实际", "实测值", "检验员", "备注", "页数", "复核人", "检验结论")
REJECT_WORDS, REPAIR_WORDS, CLOSED_WORDS = ("超差", "不合格", "废品"), ("超差", "同意使用", "满足设计要求", "让步接收"), ("已退回", "已隔离", "已闭环", "已修复", "闭环")
HEADER_FIELDS, LABEL_FIELDS, PAIRING_WORDS = ("零件号", "批次"), ("入库箱数", "装箱数量"), ("配套", "序列号", "序号")

RULES = (
    Rule("A01", "HIGH", "date not written as eight digits with points", exclude=SUPPLIER, params={"skip_if_contains": ("年", "月", "日")}),
    Rule("A02", "HIGH", "range with a dash", params={"units": UNITS}),
    Rule("A03", "HIGH", "diameter sign other than capital phi", exclude=SUPPLIER, params={"forbidden": DIAMETERS}),
    Rule("A04", "HIGH", "diameter range without its second phi"),
    Rule("A05", "LOW", "millimetre could be left out", enabled=False, exclude=SUPPLIER),
    Rule("A06", "HIGH", "unit in the wrong case", params={"wrong_to_right": UNIT_CASE}),
    Rule("A07", "MEDIUM", "square or cubic unit", exclude=SUPPLIER),
    Rule("A08", "HIGH", "quantity in Chinese words"),
    Rule("A09", "MEDIUM", "page number of a multi-page record", exclude=SUPPLIER, params={"min_pages": 2, "strict_order": False, "flag_missing": False}),
    Rule("A10", "MEDIUM", "too many decimals", exclude=SUPPLIER, params={"max_decimals": 3, "require_keywords": WEIGHING}),
    Rule("A11", "MEDIUM", "symmetric tolerance without plus-minus"),
    Rule("A12", "HIGH", "special record left empty", enabled=False),
    Rule("A13", "HIGH", "wording of the copy stamp", params={"required_text": COPY_WORDING, "known_variants": COPY_VARIANTS}),
    Rule("A14", "HIGH", "verdicts and measurements in one column", params={"column_headers": RESULT_HEADERS}),
    Rule("A15", "HIGH", "measurement without its unit", enabled=False, params={"keywords": QUANTITIES, "row_band_factor": 1.2}),
    Rule("A16", "MEDIUM", "several points not listed", enabled=False, exclude=SUPPLIER, params={"max_listed": 5, "actual_headers": ACTUAL_HEADERS}),
    Rule("A17", "MEDIUM", "fewer decimals than specified", exclude=SUPPLIER, params={"spec_headers": SPEC_HEADERS, "actual_headers": ACTUAL_HEADERS}),
    Rule("A18", "HIGH", "copy without a reviewer's signature", params={"labels": REVIEWERS, "flag_missing_field": False}),
    Rule("B01", "HIGH", "tilted stamp", params={"max_tilt_deg": 10.0}),
    Rule("B02", "HIGH", "overlapping stamps", params={"min_coverage": 0.5, "min_seal_area_ratio": 0.0006}),
    Rule("B03", "HIGH", "stamp on a date", params={"min_overlap_ratio": 0.25}),
    Rule("B04", "MEDIUM", "blank cell without a slash", exclude=CONTENTS, params={"downstream_whitelist": DOWNSTREAM, "min_cell_area_ratio": 0.0008, "max_cell_area_ratio": 0.06, "group_as_column": 3, "check_all_fields": False, "field_whitelist": CELL_FIELDS}),
    Rule("B05", "MEDIUM", "copy stamp not at the lower right", params={"right_bottom_x": 0.5, "right_bottom_y": 0.6}),
    Rule("B06", "CRITICAL", "too many struck lines", exclude=SUPPLIER, params={"max_per_page": 3}),
    Rule("B07", "HIGH", "inspector column without a stamp", exclude=CONTENTS, params={"column_headers": INSPECTORS, "region_red_ratio": 0.002, "skip_copy_pages": True}),
    Rule("B08", "HIGH", "no red on the page", exclude=CONTENTS, params={"min_red_pixel_ratio": 0.00002, "skip_copy_pages": True}),
    Rule("B09", "LOW", "page number not at the foot's centre", enabled=False, exclude=CONTENTS, params={"footer_from": 0.88, "center_from": 0.33, "center_to": 0.67}),
    Rule("B10", "MEDIUM", "blue handwriting", exclude=SUPPLIER, params={"min_blue_ratio": 0.0006}),
    Rule("B12", "MEDIUM", "unclear stamp", exclude=SUPPLIER, params={"reject_labels": ("chipped", "blurred", "faint"), "min_confidence": 0.75, "pad_ratio": 0.15, "max_per_page": 12}),
    Rule("B13", "HIGH", "stamp upside down", exclude=SUPPLIER, params={"reject_labels": ("upside_down",), "min_confidence": 0.8, "pad_ratio": 0.15, "max_per_page": 12}),
    Rule("F01", "HIGH", "slash where the next stage writes", include=("质量证明单",)),
    Rule("F02", "MEDIUM", "no design version", include=("质量证明单",)),
    Rule("F03", "HIGH", "report without its page count", include=("质量证明单", "呈报单")),
    Rule("F04", "HIGH", "repair notice without a stamp", include=("故障修理通知单",), params={"min_red_pixel_ratio": 0.00002}),
    Rule("F05", "HIGH", "repair without closure", include=("故障修理通知单",), params={"trigger_keywords": REPAIR_WORDS, "closure_keywords": CLOSED_WORDS}),
    Rule("F06", "HIGH", "inspection header incomplete", include=("检验记录",), params={"required_fields": HEADER_FIELDS}),
    Rule("F07", "MEDIUM", "rejection without a note number", include=("检验记录", "质量证明单"), params={"trigger_keywords": REJECT_WORDS}),
    Rule("F08", "LOW", "form of a hardness record", include=("检验记录", "质量证明单")),
    Rule("F09", "HIGH", "label quantity empty", include=("入库单据",), params={"required_fields": LABEL_FIELDS}),
    Rule("F10", "MEDIUM", "substitute without pairing", include=("代料单",), params={"keywords": PAIRING_WORDS}),
    Rule("F11", "MEDIUM", "report without batch note", include=("呈报单",)),
    Rule("F12", "MEDIUM", "certificate without closure note", include=SUPPLIER),
    Rule("U01", "CRITICAL", "pages missing", exclude=CONTENTS, params={"flag_missing_head": False}),
    Rule("U02", "HIGH", "page numbers repeat or skip", exclude=CONTENTS),
    Rule("U03", "MEDIUM", "pages without a number", exclude=CONTENTS, params={"min_pages": 2}),
    Rule("U04", "HIGH", "record handed on twice", exclude=("卷宗目录",), params={"min_text_len": 60}),
)
BOOK = {r.id: r for r in RULES}


def with_packs(book: dict[str, Rule], *packs: dict[str, dict]) -> dict[str, Rule]:
    """Later packs win, field by field; params are merged. An unknown rule or level is an error."""
    out = dict(book)
    for pack in packs:
        for rule_id, change in pack.items():
            if rule_id not in out:
                raise ValueError(f"a pack changes {rule_id}, which isn't in the catalog")
            out[rule_id] = _changed(out[rule_id], change)
    return out


def with_overrides(book: dict[str, Rule], overrides: dict[str, dict]) -> dict[str, Rule]:
    """Stored overrides: null keeps a field; params that are no JSON object are ignored; unknown rules too."""
    out = dict(book)
    for rule_id, o in overrides.items():
        if rule_id in out:
            params = o.get("params")
            if isinstance(params, str):
                try:
                    params = json.loads(params)
                except ValueError:
                    params = None
            out[rule_id] = _changed(out[rule_id], {k: v for k, v in {**o, "params": params if isinstance(params, dict) else None}.items() if v is not None})
    return out


def _changed(rule: Rule, change: dict) -> Rule:
    if (level := str(change.get("level") or rule.level).upper()) not in LEVELS:
        raise ValueError(f"{rule.id}: level {level} isn't one of {LEVELS}")
    params = dict(change.get("params") or {})
    forms = {"include": params.pop("applies_to", change.get("include", rule.include)), "exclude": params.pop("exclude_forms", change.get("exclude", rule.exclude))}
    named = {k: str(change.get(k) or getattr(rule, k)) for k in ("title", "clause")}
    return replace(rule, level=level, enabled=truth(change.get("enabled", rule.enabled)), **named, **{k: tuple(v or ()) for k, v in forms.items()}, params={**rule.params, **params})


def difference(rule: Rule, params: dict) -> dict:
    """The params that differ from the rule's own; an unknown name is an error."""
    if unknown := set(params) - set(rule.params):
        raise ValueError(f"{rule.id} has no {', '.join(sorted(unknown))}")
    return {k: v for k, v in params.items() if v != rule.params[k]}


def truth(value: object) -> bool:
    """What a configuration file means by a word."""
    return value.strip().lower() not in ("false", "0", "off", "no", "") if isinstance(value, str) else bool(value)


def fingerprint(*sources: tuple[str, bytes]) -> str:
    """16 digits over the names and contents of the catalog's files."""
    h = hashlib.sha256()
    for name, content in sources:
        h.update(name.encode() + b"\0" + content + b"\0")
    return h.hexdigest()[:16]


def as_table(spark: SparkSession, book: dict[str, Rule] | None = None) -> DataFrame:
    """rule_id, level, title, rank: one row a rule, a few dozen."""
    rows = [(r.id, r.level, r.title, LEVELS.index(r.level)) for r in (book or BOOK).values()]
    return spark.createDataFrame(rows, "rule_id string, level string, title string, rank int")
