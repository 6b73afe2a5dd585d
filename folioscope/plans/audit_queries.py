"""The whole audit over derived pages, with a relational twin: rules over lines and cells, digests, units, unit rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..sources import derived
from . import catalog as c
from . import page_queries as pq
from . import unit_queries as uq

_PARTS = ("lines", "cells")
_CY, _CX = "(y + h / 2.0)", "(x + w / 2.0)"
#: Page digests of the derived pages: the marker of the first line that tells both numbers, the value of the one key field.
_DIGEST = f"""SELECT p.doc_id, p.page_no, p.form_type, nullif(k.part, '') AS part, CAST(split_part(m.v, '/', 1) AS INT) AS marker, CAST(split_part(m.v, '/', 2) AS INT) AS total, t.has_title, CAST(length(t.body) AS INT) AS text_len,
  CASE WHEN length(regexp_replace(t.body, '\\s+', '', 'g')) < 20 THEN '' ELSE left(sha1(regexp_replace(t.body, '\\s+', '', 'g')), 16) END AS fingerprint
  FROM page p LEFT JOIN (SELECT doc_id, page_no, substr(regexp_replace(content, '\\s+', '', 'g'), 1, 30) AS part FROM {pq._labelled("零件号")}) k USING (doc_id, page_no)
  LEFT JOIN (SELECT doc_id, page_no, arg_min(v, line_no) AS v FROM (SELECT *, CASE WHEN regexp_matches(text, '第 *[0-9]+ *页') AND regexp_matches(text, '共 *[0-9]+ *页') THEN regexp_extract(text, '第 *([0-9]+) *页', 1) || '/' || regexp_extract(text, '共 *([0-9]+) *页', 1)
    WHEN CAST(nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{{1,3}})/([0-9]{{1,3}})页', 1), '') AS INT) BETWEEN 1 AND CAST(nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{{1,3}})/([0-9]{{1,3}})页', 2), '') AS INT) THEN regexp_extract(text, '(?:^|[^0-9])([0-9]{{1,3}}/[0-9]{{1,3}})页', 1) END AS v FROM tlines) z WHERE v IS NOT NULL GROUP BY ALL) m USING (doc_id, page_no)
  LEFT JOIN (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY floor({_CY} / 20), {_CX}, line_no) AS body, bool_or({_CY} <= height * 0.3 AND regexp_matches(text, '证明单|流水卡片|配套单|装配信息单|检验记录|报告单|通知单|合格证|检查表')) AS has_title FROM tlines GROUP BY ALL) t USING (doc_id, page_no)"""
_SEG = uq._SEG.replace(f"WITH RECURSIVE dg AS MATERIALIZED ({uq._DIGEST})", f"{derived.sql_with(*_PARTS).replace('WITH page', 'WITH RECURSIVE page', 1)}, dg AS MATERIALIZED ({_DIGEST})", 1)
_ON_CELLS = {"F01": pq.ORACLES["F01"].split(derived.sql_with(*pq.PARTS["F01"]), 1)[1]}
_RULES = " UNION ALL ".join([*pq._ON_LINES.values(), *_ON_CELLS.values()])
_UNIT_RULES = " UNION ALL ".join(uq.S[n].split(uq._SEG, 1)[1] for n in ("u01_missing_pages", "u02_page_sequence", "u03_unnumbered", "u04_repeated_record"))
_NAMES = f"names(rule_id, level, title) AS (VALUES {pq._CATALOG})"
_FOUND = f"""{_SEG}, {_NAMES}, rfound AS ({_RULES}), ufound AS ({_UNIT_RULES}), whole AS (
  SELECT DISTINCT f.doc_id, f.page_no, CAST(NULL AS VARCHAR) AS unit_id, f.rule_id, n.level, n.title || coalesce(': ' || f.detail, '') AS message, f.evidence, f.confidence, coalesce(l.x, k.x) AS x, coalesce(l.y, k.y) AS y, coalesce(l.w, k.w) AS w, coalesce(l.h, k.h) AS h
  FROM rfound f JOIN names n USING (rule_id) LEFT JOIN tlines l ON f.rule_id <> 'F01' AND l.doc_id = f.doc_id AND l.page_no = f.page_no AND l.line_no = f.no LEFT JOIN cells k ON f.rule_id = 'F01' AND k.doc_id = f.doc_id AND k.page_no = f.page_no AND k.cell_no = f.no
  UNION ALL SELECT doc_id, page_no, min(unit_id), rule_id, level, message, CAST(NULL AS VARCHAR), min(confidence), NULL, NULL, NULL, NULL FROM (SELECT u.*, n.level, n.title || coalesce(': ' || u.detail, '') AS message FROM ufound u JOIN names n USING (rule_id)) z GROUP BY doc_id, page_no, rule_id, level, message)"""
FINDINGS_SQL = f"{_FOUND} SELECT doc_id, page_no, unit_id, rule_id, level, message, evidence, confidence, x, y, w, h FROM whole"
REPORT_SQL = f"""{_FOUND}, per AS (SELECT doc_id, rule_id, count(*) AS findings, count(DISTINCT page_no) AS spread FROM whole GROUP BY ALL),
  wide AS (SELECT per.* FROM per JOIN (SELECT doc_id, count(DISTINCT page_no) AS n FROM page GROUP BY 1) g USING (doc_id) WHERE findings >= 5 AND spread >= 0.6 * n),
  rest AS (SELECT per.* FROM per ANTI JOIN wide USING (doc_id, rule_id)), batch AS (SELECT rule_id, sum(findings) AS findings, count(*) AS spread FROM rest GROUP BY 1 HAVING sum(findings) >= 30)
  SELECT 'systemic' AS kind, doc_id, rule_id, CAST(findings AS BIGINT) AS findings, CAST(spread AS BIGINT) AS spread FROM wide UNION ALL SELECT 'batch', NULL, rule_id, CAST(findings AS BIGINT), spread FROM batch UNION ALL SELECT 'single', doc_id, rule_id, CAST(findings AS BIGINT), spread FROM rest WHERE rule_id NOT IN (SELECT rule_id FROM batch)"""


def _audited(spark, sf_dir: str):
    pages = derived.pages(spark, sf_dir, *_PARTS, apart=True)
    return audit.audit(pages, book=c.BOOK)[0], pages


def audit_findings(spark, sf_dir: str):
    found, _ = _audited(spark, sf_dir)
    return found.select("doc_id", "page_no", "unit_id", "rule_id", "level", "message", "evidence", "confidence", *[F.col(f"box.{x}").alias(x) for x in "xywh"])


def audit_report(spark, sf_dir: str):
    found, pages = _audited(spark, sf_dir)
    return audit.report(found, pages)


QUERIES = {"audit_findings": audit_findings, "audit_report": audit_report}
SQL = {"audit_findings": FINDINGS_SQL, "audit_report": REPORT_SQL}
