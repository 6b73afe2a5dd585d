"""Sinks: the findings report, ledgers for spreadsheets, reviews and gold sets as JSON.

Reports are for people and for one run; each is written by one task, after the rows were aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as f

BOM, LEDGER = "﻿", ("no", "doc_id", "page_no", "rule_id", "level", "title", "message", "clause", "confidence", "verdict", "reviewer", "note")


def report_json(findings: DataFrame, pages: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """One row, value: the report as JSON with statistics, systemic rows, pages, units (if given) and all findings by severity. findings has seq, message, level."""
    systemic, batch, _ = f.collapse(findings, pages)
    order = F.struct(f.level_rank(F.col("level")).alias("rank"), "doc_id", "page_no", "rule_id", "seq")
    entry = F.struct(order.alias("o"), F.struct(*[c for c in findings.columns if c != "seq"]).alias("e"))
    listed = findings.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("findings"))
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    out = f.statistics(findings, pages).select(F.struct("*").alias("stats"))
    parts = [rows(systemic, "systemic"), rows(batch, "batch"), listed, rows(pages, "pages")]
    for part in parts if units is None else [*parts, rows(units.select("doc_id", "unit_id", "form_type", "pages", "page_count", "declared_total"), "units")]:
        out = out.join(F.broadcast(part))  # one row each
    return out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_report(findings: DataFrame, pages: DataFrame, path: str) -> None:
    report_json(findings, pages).coalesce(1).write.mode("overwrite").text(path)


def ledger_csv(rows: DataFrame, columns: tuple[str, ...] = LEDGER) -> DataFrame:
    """value: lines of a ledger for spreadsheets, each ending in CR (the text sink adds LF), the header with a byte order mark first. rows has no, its order."""

    def field(name: str):
        x = F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), "[\r\n]", " ")
        return F.when(x.rlike('[,"]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    have = [c for c in columns if c in rows.columns]
    head = rows.sparkSession.createDataFrame([(0, BOM + ",".join(have) + "\r")], "no int, value string")
    body = rows.select(F.col("no").cast("int").alias("no"), F.concat(F.concat_ws(",", *map(field, have)), F.lit("\r")).alias("value"))
    return head.union(body).orderBy("no").select("value")


def review_json(verdicts: DataFrame, reviewer: str) -> DataFrame:
    """One row, value: verdicts (verdict, doc_id, page_no, rule_id, note) in the form that reviews are read in."""
    entry = F.struct("verdict", "doc_id", "page_no", "rule_id", "note")
    return verdicts.agg(F.to_json(F.struct(F.lit(reviewer).alias("reviewer"), F.array_sort(F.collect_list(entry)).alias("adjudications"))).alias("value"))


def gold_json(gold: DataFrame) -> DataFrame:
    """One row, value: a gold set (doc_id, page_no, rule_id, kind, unsure) sorted by key."""
    key = F.struct("doc_id", "page_no", "rule_id")
    pick = lambda when: F.array_sort(F.collect_list(F.when(when, key)))
    return gold.agg(F.to_json(F.struct(pick(F.col("kind") == "positive").alias("findings"), pick(F.col("kind") == "negative").alias("false_positives"), pick(F.col("unsure")).alias("unsure"))).alias("value"))
