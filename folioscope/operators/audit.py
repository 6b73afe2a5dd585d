"""The audit of archives as one flow: page rules, repeats dropped, digests, units, unit rules, and the report's collapsing.

Page rules and their repeats stay within the page row (no shuffle); digests meet by archive once. Findings carry what the
catalog says of their rule (level, title, clause), a message, and a box: the line's, cell's or seal's, or the rule's own.
A rule that couldn't be checked on a page is a LOW finding of its own title there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans import catalog as c
from . import classify, findings, page_rules, ranges, segment

#: Rules whose number is a cell's or a seal's; all others name lines.
CELL_RULES, SEAL_RULES = ("B04", "F01", "F09"), ("B01", "B02", "B03")


def _of(book: dict[str, c.Rule], field: str, rule: str) -> str:
    """SQL for a field of a rule's catalog entry."""
    return f"element_at(map({', '.join(f'{t.quoted(r)}, {t.quoted(str(getattr(x, field)))}' for r, x in book.items())}), {rule})"


def _boxed(pages: DataFrame) -> str:
    """SQL for the box of a finding e."""
    at = lambda rows, no: f"get(transform(filter({rows}, k -> k.{no} = e.f.no), k -> {page_rules.box('k.x', 'k.y', 'k.w', 'k.h')}), 0)" if rows in pages.columns else f"CAST(NULL AS {page_rules.BOX})"
    among = lambda rules: f"e.rule_id IN ({', '.join(map(t.quoted, rules))})"
    return f"coalesce(e.f.box, CASE WHEN {among(CELL_RULES)} THEN {at('cells', 'cell_no')} WHEN {among(SEAL_RULES)} THEN {at('seals', 'seal_no')} ELSE {at('lines', 'line_no')} END)"


def page_findings(pages: DataFrame, *rules: str, book: dict[str, c.Rule] | None = None) -> DataFrame:
    """doc_id, page_no, rule_id, level, title, clause, message, evidence, confidence, box: of findings with equal rule, message and box the first."""
    book = book or c.BOOK
    found = page_rules.told(pages, *rules, book=book, boxes=_boxed(pages))
    failed = f"confidence = 0 AND detail = {t.quoted(page_rules.FAILED)}"
    entries = ", ".join(f"{t.quoted(r)}, named_struct('level', {t.quoted(x.level)}, 'title', {t.quoted(x.title)}, 'clause', {t.quoted(str(x.clause))})" for r, x in book.items())
    named = found.withColumn("entry", F.expr(f"if({failed}, named_struct('level', 'LOW', 'title', 'rule failed', 'clause', ''), element_at(map({entries}), rule_id))"))
    return named.select("doc_id", "page_no", "rule_id", "entry.level", "entry.title", "entry.clause", F.expr("concat(entry.title, coalesce(concat(': ', detail), ''))").alias("message"), "evidence", "confidence", "box")


def digests(pages: DataFrame) -> DataFrame:
    """What segmentation reads of each page; unknown lines and cells are none."""
    have = page_rules.prepared(pages.withColumns({x: F.coalesce(x, F.array().cast(pages.schema[x].dataType)) for x in ("lines", "cells") if x in pages.columns}))
    return have.select("doc_id", "page_no", "form_type", *[F.expr(sql).alias(name) for name, sql in classify.digest().items()])


def unit_findings(units: DataFrame, book: dict[str, c.Rule] | None = None) -> DataFrame:
    """Findings of unit rules with the catalog's fields; one of a rule, page and message."""
    book = book or c.BOOK
    rows = segment.findings(units, book)
    named = rows.select("doc_id", "page_no", "unit_id", "rule_id", *[F.expr(_of(book, x, "rule_id")).alias(x) for x in ("level", "title", "clause")], F.lit(None).cast("string").alias("evidence"), "detail", "confidence")
    told = named.withColumn("message", F.expr("concat(title, coalesce(concat(': ', detail), ''))")).drop("detail")
    first = told.groupBy("doc_id", "page_no", "rule_id", "message").agg(F.min(F.struct("unit_id", "level", "title", "clause", "evidence", "confidence")).alias("r"))
    return first.select("doc_id", "page_no", "rule_id", "message", "r.*")


def audit(pages: DataFrame, *, book: dict[str, c.Rule] | None = None, forms: classify.Forms | None = None, long_archives: bool = False) -> tuple[DataFrame, DataFrame]:
    """Findings of pages and units, and the units. pages: nested rows with lines and cells; form_type is recognised if forms are given; long_archives: archives are cut at pages 1 and folded in pieces."""
    if forms is not None:
        pages = pages.withColumn("form_type", F.expr(forms.sql()))
    told = digests(pages)
    units = segment.units(segment.page_units(told, split=long_archives))
    of_pages, of_units = page_findings(pages, book=book).withColumn("unit_id", F.lit(None).cast("string")), unit_findings(units, book).withColumn("box", F.lit(None).cast(page_rules.BOX))
    return of_pages.unionByName(of_units), units


def report(found: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, doc_id, rule_id, findings, spread: what collapses within an archive (systemic; spread: pages), over archives (batch; documents), and what stays single.

    Everything follows from one aggregate by archive and rule, which is written once: the rules run once, whatever reads it."""
    size = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("doc_pages"))
    per = found.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("page_no").alias("spread"))
    systemic = (F.col("findings") >= findings.SYSTEMIC_FINDINGS) & (F.col("spread") >= findings.SYSTEMIC_SHARE * F.col("doc_pages"))
    per = ranges.written(per, "report")
    judged = per.join(size, "doc_id", "left").withColumn("wide", F.coalesce(systemic, F.lit(False)))
    rules = judged.where("not wide").groupBy("rule_id").agg(F.sum("findings").alias("total")).where(F.col("total") >= findings.BATCH_FINDINGS)  # a row a rule, a few dozen
    kind = F.when(F.col("wide"), "systemic").when(F.col("total").isNotNull(), "batch").otherwise("single")
    told = judged.join(F.broadcast(rules), "rule_id", "left").withColumn("kind", kind)
    batch = F.col("kind") == "batch"
    keyed = told.select("kind", F.when(~batch, F.col("doc_id")).alias("doc_id"), "rule_id", "findings", F.when(batch, 1).otherwise(F.col("spread")).alias("spread"))
    return keyed.groupBy("kind", "doc_id", "rule_id").agg(F.sum("findings").alias("findings"), F.sum("spread").alias("spread"))
