"""Archives into document units: a sequential fold over an archive's pages, interleaved parts joined, unit rules.

Input is page_digest: doc_id, page_no, form_type, keys (map of field to value), marker (current, total; may be null), has_title,
text_len, fingerprint. The fold runs inside one SQL aggregate per archive, in page order; archives are what one task
holds, and their pages are few. Longer ones are cut at every page numbered 1, where the fold starts anew whatever came before
(`page_units(split=True)`, `segment_long`); the pieces are folded on their own and their units counted through. The fold
copies its output array, so pieces of thousands of pages take `segment_long`, an Arrow function of the same rules over sorted partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import catalog as c
from . import ranges

_STATE = """named_struct('unit', 0, 'form', CAST(NULL AS STRING), 'keys', CAST(map() AS map<string,string>), 'last', CAST(NULL AS struct<current:int,total:int>),
  'declared', CAST(NULL AS INT), 'marked', false, 'pages', 0, 'out', CAST(array() AS array<int>))"""

#: Whether page d starts a new unit after state s: first page; another value for a key; page 1; else not if the number
#: follows; else the unit is full; else another form; else a title with keys.
_STARTS = f"""s.unit = 0 OR CASE
  WHEN exists(map_keys(d.keys), k -> map_contains_key(s.keys, k) AND try_element_at(s.keys, k) <> try_element_at(d.keys, k)) THEN true
  WHEN d.marker IS NOT NULL AND d.marker.current = 1 THEN true
  WHEN d.marker IS NOT NULL AND s.last IS NOT NULL AND d.marker.current = s.last.current + 1 AND d.marker.total = s.last.total THEN false
  WHEN coalesce(s.declared, 0) > 0 AND s.pages >= s.declared THEN true
  WHEN d.form_type <> s.form AND d.form_type <> '{c.UNKNOWN_FORM}' AND s.form <> '{c.UNKNOWN_FORM}' THEN true
  ELSE d.has_title AND size(d.keys) > 0 END"""

_STEP = """transform(array(STARTS), new -> named_struct(
  'unit', s.unit + if(new, 1, 0), 'form', if(new, d.form_type, s.form),
  'keys', if(new, d.keys, map_concat(s.keys, map_filter(d.keys, (k, v) -> NOT map_contains_key(s.keys, k)))),
  'last', if(new, d.marker, coalesce(d.marker, s.last)),
  'declared', CASE WHEN d.marker IS NULL THEN if(new, NULL, s.declared) WHEN new OR NOT s.marked THEN if(d.marker.current = 1, d.marker.total, NULL) ELSE s.declared END,
  'marked', (NOT new AND s.marked) OR d.marker IS NOT NULL, 'pages', if(new, 1, s.pages + 1), 'out', concat(s.out, array(s.unit + if(new, 1, 0)))))[0]"""


def stretches(digests: DataFrame) -> DataFrame:
    """digests with stretch: the number of the last page 1 up to the page, 0 before the first. A page 1 starts a unit whatever came before, so that stretches don't depend on each other."""
    first = F.when(F.col("marker.current") == 1, F.col("page_no"))
    return ranges.running(digests, "doc_id", "page_no", first, "stretch", how="max").withColumn("stretch", F.coalesce("stretch", F.lit(0)))


def _behind(numbered: DataFrame) -> DataFrame:
    """Unit numbers within stretches (doc_id, stretch, unit_no, ...) as those within archives."""
    sizes = numbered.groupBy("doc_id", "stretch").agg(F.max("unit_no").alias("n"))
    before = ranges.running(sizes, "doc_id", "stretch", F.col("n"), "before", own=False).select(F.col("doc_id").alias("_doc"), F.col("stretch").alias("_stretch"), "before")
    joined = numbered.join(before, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("stretch") == F.col("_stretch")))
    return joined.withColumn("unit_no", (F.col("unit_no") + F.coalesce("before", F.lit(0))).cast("int")).drop("_doc", "_stretch", "before", "stretch")


def page_units(digests: DataFrame, *, split: bool = False) -> DataFrame:
    """digests with unit_no, the number of a page's unit within its archive before joining. split: archives are cut at pages 1 and folded piece by piece, for archives of more pages than a task should hold."""
    entry = "named_struct('page_no', page_no, 'form_type', form_type, 'keys', map_entries(keys), 'marker', marker, 'has_title', has_title, 'text_len', text_len, 'fingerprint', fingerprint)"
    key = ("doc_id", "stretch") if split else ("doc_id",)
    grouped = (stretches(digests) if split else digests).groupBy(*key).agg(F.expr(f"array_sort(collect_list({entry}))").alias("pages"))
    pages = "transform(pages, p -> named_struct('page_no', p.page_no, 'form_type', p.form_type, 'keys', map_from_entries(p.keys), 'marker', p.marker, 'has_title', p.has_title, 'text_len', p.text_len, 'fingerprint', p.fingerprint))"
    units = f"aggregate(ds, {_STATE}, (s, d) -> {_STEP.replace('STARTS', _STARTS)}, s -> s.out)"
    out = grouped.select(*key, F.expr(pages).alias("ds")).select(*key, F.explode(F.expr(f"zip_with(ds, {units}, (d, u) -> named_struct('d', d, 'unit_no', u))")).alias("x")).select(*key, "x.d.*", "x.unit_no")
    return _behind(out) if split else out


def numbering() -> Callable[[str, object, dict | None, bool], int]:
    """The same rules as a function that is given one archive's pages in order (form_type, keys, marker, has_title) and gives each its unit."""
    unit, form, keys, last, declared, marked, n = 0, None, {}, None, None, False, 0

    def step(page_form, page_keys, m, title) -> int:
        nonlocal unit, form, keys, last, declared, marked, n
        k = dict(page_keys or ())
        if not unit or any(x in keys and keys[x] != v for x, v in k.items()) or m and m["current"] == 1:
            new = True
        elif m and last and (m["current"], m["total"]) == (last["current"] + 1, last["total"]):
            new = False
        else:
            new = bool(declared and n >= declared) or (page_form != form and c.UNKNOWN_FORM not in (page_form, form)) or bool(title and k)
        if new:
            unit, form, keys, last, declared, marked, n = unit + 1, page_form, {}, None, None, False, 0
        n += 1
        keys = {**k, **keys}
        if m:
            if not marked and m["current"] == 1:
                declared = m["total"]
            last, marked = m, True
        return unit

    return step


def unit_numbers(rows: list[dict]) -> list[int]:
    """numbering() over a list of one archive's pages."""
    step = numbering()
    return [step(r["form_type"], r["keys"], r["marker"], r["has_title"]) for r in rows]


def segment_long(digests: DataFrame) -> DataFrame:
    """The same unit numbers by a loop over each stretch of an archive, for archives of very many pages: doc_id, page_no, unit_no.

    Stretches are sorted within partitions and streamed through one loop: a stretch is never held, and Python is entered by the batch, not by the stretch, which most archives have a few pages for."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, at = numbering(), None
        for b in batches:
            docs, starts, numbers = (b.column(i).to_pylist() for i in range(3))
            out = []
            for key, row in zip(zip(docs, starts, strict=True), zip(*(b.column(i).to_pylist() for i in range(3, 7)), strict=True), strict=True):
                if key != at:
                    step, at = numbering(), key
                out.append(step(*row))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(starts, pa.int32()), pa.array(numbers, pa.int32()), pa.array(out, pa.int32())], names=["doc_id", "stretch", "page_no", "unit_no"])

    cut = stretches(digests.select("doc_id", "page_no", "form_type", "keys", "marker", "has_title"))
    rows = cut.select("doc_id", "stretch", "page_no", "form_type", "keys", "marker", "has_title").repartition("doc_id", "stretch").sortWithinPartitions("doc_id", "stretch", "page_no")
    return _behind(rows.mapInArrow(number, "doc_id string, stretch int, page_no int, unit_no int")).select("doc_id", "page_no", "unit_no")


def units(paged: DataFrame) -> DataFrame:
    """Units from page_units(): parts of one form and the same keys are one unit, named after the first; keyless parts stay apart."""
    flat = paged.withColumn("keys", F.array_sort(F.map_entries("keys")))
    parts = flat.groupBy("doc_id", "unit_no").agg(
        F.min_by("form_type", "page_no").alias("form_type"),
        F.array_sort(F.collect_list("page_no")).alias("pages"),
        F.expr("array_sort(collect_list(if(marker IS NULL, NULL, named_struct('page_no', page_no, 'current', marker.current, 'total', marker.total))))").alias("markers"),
        F.expr("array_sort(collect_list(named_struct('page_no', page_no, 'keys', keys)))").alias("keyed"),
        F.expr("collect_list(if(fingerprint <> '', named_struct('fingerprint', fingerprint, 'page_no', page_no, 'text_len', text_len), NULL))").alias("prints"),
    )
    # the first value of each field within a part
    first = "aggregate(flatten(transform(keyed, x -> x.keys)), CAST(array() AS array<struct<key:string,value:string>>), (a, e) -> if(exists(a, f -> f.key = e.key), a, concat(a, array(named_struct('key', e.key, 'value', e.value)))), a -> array_sort(a))"
    parts = parts.withColumn("keys", F.expr(first)).drop("keyed")
    parts = parts.withColumn("declared", F.expr("if(size(markers) > 0 AND markers[0].current = 1, markers[0].total, NULL)"))
    signature = F.when(F.size("keys") == 0, F.concat(F.lit("#"), F.col("unit_no"))).otherwise(F.concat(F.col("form_type"), F.lit("|"), F.expr("array_join(transform(keys, e -> concat(e.key, '=', e.value)), '|')")))
    joined = parts.withColumn("signature", signature).groupBy("doc_id", "signature").agg(
        F.min("unit_no").alias("unit_no"),
        F.min_by("form_type", "unit_no").alias("form_type"),
        F.array_sort(F.flatten(F.collect_list("pages"))).alias("pages"),
        F.expr("array_sort(collect_list(named_struct('unit_no', unit_no, 'markers', markers)))").alias("runs"),
        F.expr("min_by(declared, unit_no) FILTER (WHERE declared IS NOT NULL)").alias("declared_total"),
        F.min_by("keys", "unit_no").alias("keys"),
        F.flatten(F.collect_list("prints")).alias("prints"),
    )
    markers = F.expr("flatten(transform(runs, r -> r.markers))")
    name = F.concat(F.col("doc_id"), F.lit("#U"), F.expr("lpad(unit_no, greatest(3, length(unit_no)), '0')"))  # lpad cuts what is longer
    return joined.withColumn("markers", markers).select("doc_id", name.alias("unit_id"), "unit_no", "form_type", "pages", F.size("pages").alias("page_count"), F.element_at("pages", 1).alias("start_page"), F.element_at("pages", -1).alias("end_page"), "declared_total", F.expr("get(markers, 0)").alias("first_marker"), "markers", "keys", "prints")


def listed(u: DataFrame, doc_id: str | None = None) -> DataFrame:
    """The units of a run by doc_id and first page, of one document if asked for."""
    return (u if doc_id is None else u.where(F.col("doc_id") == doc_id)).orderBy("doc_id", "start_page")


def _rules(book: dict[str, c.Rule], flag_head: bool | None = None) -> dict[str, tuple[str, str, str, str]]:
    """The rules over one unit's row as SQL over the columns of _measured(): which units, page, detail, confidence."""
    head = c.truth(book["U01"].params["flag_missing_head"]) if flag_head is None and "U01" in book else bool(flag_head)
    short = "coalesce(declared_total, 0) > 0 AND page_count < declared_total"
    listed_ = lambda xs: f"array_join(transform({xs}, x -> CAST(x AS STRING)), ',')"
    least = int(book["U03"].params["min_pages"]) if "U03" in book else 2
    return {
        "U01": (f"({short}) OR ({str(head).lower()} AND NOT ({short}) AND first_marker.current > 1)", "start_page", f"if({short}, declared_total - page_count, first_marker.current - 1)", f"if({short}, 0.7D, 0.45D)"),
        "U02": ("size(markers) >= 2 AND (size(dup) > 0 OR size(gap) > 0)", "start_page", f"if(size(dup) > 0, concat('repeats ', {listed_('dup')}), concat('lacks ', array_join(gap, ',')))", "0.6D"),
        "U03": (f"page_count >= {least} AND size(array_distinct(transform(markers, m -> m.current))) < page_count AND size(bare) > 0", "bare[0]", f"concat(size(bare), ': ', {listed_('slice(bare, 1, 6)')})", "0.55D"),
    }


def _measured(u: DataFrame) -> DataFrame:
    """u with what the rules read: page numbers in order, those that repeat, the ranges missing between neighbours of them, pages without one."""
    seq = u.withColumn("seq", F.expr("array_sort(transform(markers, m -> CAST(m.current AS BIGINT)))"))
    dup, step = "array_distinct(filter(seq, (x, i) -> i > 0 AND seq[i - 1] = x))", "seq[i + 1] - x"
    gap = f"filter(transform(seq, (x, i) -> CASE WHEN i + 1 >= size(seq) OR {step} < 2 THEN NULL WHEN {step} = 2 THEN CAST(x + 1 AS STRING) ELSE concat(x + 1, '-', seq[i + 1] - 1) END), g -> g IS NOT NULL)"
    return seq.withColumns({"dup": F.expr(dup), "gap": F.expr(gap), "bare": F.expr("array_except(pages, transform(markers, m -> m.page_no))")})


def _one(u: DataFrame, rule: c.Rule, flag_head: bool | None = None) -> DataFrame:
    when, page, detail, confidence = _rules({rule.id: rule}, flag_head)[rule.id]
    rows = _measured(u).where(f"({when}) AND ({rule.applies()})")
    return rows.selectExpr("doc_id", "unit_id", f"'{rule.id}' AS rule_id", f"CAST({page} AS INT) AS page_no", f"CAST({detail} AS STRING) AS detail", f"{confidence} AS confidence")


def missing_pages(u: DataFrame, flag_head: bool | None = None, rule: c.Rule = c.BOOK["U01"]) -> DataFrame:
    """Fewer pages than declared; else, if asked for, a first number above 1."""
    return _one(u, rule, flag_head)


def page_sequence(u: DataFrame, rule: c.Rule = c.BOOK["U02"]) -> DataFrame:
    """Page numbers that repeat, else those missing between the smallest and the largest, neighbours among them as a range."""
    return _one(u, rule)


def unnumbered_pages(u: DataFrame, rule: c.Rule = c.BOOK["U03"]) -> DataFrame:
    """A unit of several pages with fewer distinct numbers than pages; the first six pages without one."""
    return _one(u, rule)


def repeated_records(u: DataFrame, digests: DataFrame | None = None, rule: c.Rule = c.BOOK["U04"]) -> DataFrame:
    """Pages of one archive with the same fingerprint; reported once, for the unit that holds the first of them. digests: for units that don't carry their pages' fingerprints."""
    if "prints" not in u.columns and digests is not None:
        print_ = F.struct("fingerprint", "page_no", "text_len")
        held = u.select("doc_id", "unit_id", F.explode("pages").alias("page_no")).join(digests.where("fingerprint <> ''").select("doc_id", "page_no", "fingerprint", "text_len"), ["doc_id", "page_no"])
        u = u.join(held.groupBy("doc_id", "unit_id").agg(F.collect_list(print_).alias("prints")), ["doc_id", "unit_id"], "left")
    return findings(u, c.with_packs({"U04": rule}, {"U04": {"enabled": True}}))


def findings(u: DataFrame, book: dict[str, c.Rule] | None = None) -> DataFrame:
    """doc_id, unit_id, rule_id, page_no, detail, confidence of all enabled unit rules, in one pass over the units.

    A unit's row gives its own findings and the fingerprints of its pages; both meet in one exchange, by archive and key."""
    book = book or c.BOOK
    on = {r for r in ("U01", "U02", "U03", "U04") if r in book and book[r].enabled}
    row = lambda rule, key, page, detail, conf: f"named_struct('rule_id', '{rule}', 'key', {key}, 'page_no', CAST({page} AS INT), 'detail', CAST({detail} AS STRING), 'confidence', {conf})"
    parts = [f"if(({when}) AND ({book[r].applies()}), array({row(r, 'unit_id', page, detail, conf)}), array())" for r, (when, page, detail, conf) in _rules(book).items() if r in on]
    if "U04" in on:
        parts.append(f"transform(filter(prints, p -> p.text_len >= {int(book['U04'].params['min_text_len'])}), p -> {row('U04', 'p.fingerprint', 'p.page_no', 'NULL', '0.6D')})")
    none = "CAST(array() AS array<struct<rule_id:string,key:string,page_no:int,detail:string,confidence:double>>)"
    told = _measured(u).select("doc_id", "unit_id", "form_type", F.explode(F.expr(f"concat({', '.join([none, *parts])})")).alias("e"))
    met = told.select("doc_id", "e.rule_id", "e.key", F.struct("e.page_no", "unit_id", "form_type", "e.detail", "e.confidence").alias("r")).groupBy("doc_id", "rule_id", "key").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    fits = f"rule_id <> 'U04' OR size(rs) > 1 AND ({book['U04'].applies('rs[0].form_type') if 'U04' in on else 'false'})"
    copies = "if(rule_id = 'U04', array_join(transform(rs, r -> CAST(r.page_no AS STRING)), ','), rs[0].detail)"
    return met.where(fits).selectExpr("doc_id", "rs[0].unit_id AS unit_id", "rule_id", "rs[0].page_no AS page_no", f"{copies} AS detail", "rs[0].confidence AS confidence")
