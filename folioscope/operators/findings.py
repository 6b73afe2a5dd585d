"""What happens to findings after the rules: keys, deduplication, ranking, collapsing, statistics, verdicts, gold sets.

Order matters in several of these ("first" is the order of insertion), so it is a column, seq, and never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.catalog import LEVELS
from . import ranges

#: Collapse a rule of one archive from so many findings and such a share of its pages on; a rule of a whole batch from so many.
SYSTEMIC_FINDINGS, SYSTEMIC_SHARE, BATCH_FINDINGS, PREVIEW, TOP_DOCS = 5, 0.6, 30, 8, 5


def level_rank(level: Column, unknown: int = 9) -> Column:
    out = F.lit(unknown)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def with_key(findings: DataFrame) -> DataFrame:
    """finding_key: run, document, page, rule and the ordinal within them, in order of insertion."""
    n = F.row_number().over(Window.partitionBy("run_id", "doc_id", "page_no", "rule_id").orderBy("seq"))
    return findings.withColumn("finding_key", F.concat_ws("|", "run_id", "doc_id", F.col("page_no").cast("string"), "rule_id", n.cast("string")))


def deduplicated(findings: DataFrame, *key: str) -> DataFrame:
    """The first of each key; the key's columns and seq decide, all other columns come from that row."""
    rest = [x for x in findings.columns if x not in key]
    first = findings.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select(*key, "r.*").select(*findings.columns)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(level_rank(F.col("level")), "doc_id", "page_no", "rule_id", "seq")


def reviewed(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with their verdict, null while they are open."""
    return findings.join(verdicts.select("finding_key", "verdict"), "finding_key", "left")


def filtered(findings: DataFrame, *, level: str | None = None, rule: str | None = None, doc: str | None = None, state: str | None = None) -> DataFrame:
    """The list view's filters; state is todo (no verdict) or done."""
    out = findings
    for column, value in (("level", level), ("rule_id", rule), ("doc_id", doc)):
        out = out.where(F.col(column) == value) if value else out
    return out.where(F.col("verdict").isNull() if state == "todo" else F.col("verdict").isNotNull()) if state else out


def page_of(findings: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """One page of the list, most severe first; unknown levels rank with LOW, ties by key."""
    return findings.orderBy(level_rank(F.col("level"), 3), "doc_id", "page_no", "finding_key").offset(offset).limit(limit)


def summary(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def statistics(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages, documents, findings and a count for each level, 0 where there is none."""
    p = pages.agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("doc_id").alias("documents"))
    f = findings.agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("level") == x).alias(x.lower()) for x in LEVELS])
    return p.join(F.broadcast(f))  # one row each


def level_matrix(findings: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("level") == x).alias(x.lower()) for x in LEVELS]
    return findings.groupBy("doc_id").agg(*counts)


def archive_overview(pages: DataFrame, units: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages, units, findings and a count for each level of every document that has pages or findings, 0 where there are none."""
    p = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    u = units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"))
    n = findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("level") == x).alias(x.lower()) for x in LEVELS])
    counts = ["pages", "units", "findings", *[x.lower() for x in LEVELS]]
    return p.join(n, "doc_id", "full").join(u, "doc_id", "left").fillna(0, counts).select("doc_id", *counts)


def collapse(findings: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Systemic rows (archive and rule), batch rows (rule over the remaining), and the findings left as they are."""
    size = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("doc_pages"))
    per = findings.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("page_no").alias("hit_pages"), F.array_sort(F.collect_set("page_no")).alias("hit"), F.min_by(F.struct("page_no", "message", "level"), "seq").alias("first"))
    wide = per.join(size, "doc_id").where((F.col("findings") >= SYSTEMIC_FINDINGS) & (F.col("hit_pages") >= SYSTEMIC_SHARE * F.col("doc_pages")))
    systemic = wide.select("doc_id", "rule_id", "findings", "hit_pages", "doc_pages", F.col("first.page_no").alias("page_no"), F.col("first.message").alias("message"), F.array_join(F.slice("hit", 1, PREVIEW).cast("array<string>"), ",").alias("preview"))
    singles = findings.join(wide.select("doc_id", "rule_id"), ["doc_id", "rule_id"], "left_anti")
    docs = singles.groupBy("rule_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    best = ranges.top(docs, "rule_id", TOP_DOCS, F.desc("n"), F.asc("doc_id"), spread="doc_id").groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "n"))).alias("top"))
    sums = docs.groupBy("rule_id").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("documents")).where(F.col("findings") >= BATCH_FINDINGS)
    batch = sums.join(best, "rule_id")  # a row a rule
    named = F.array_join(F.transform("top", lambda t: F.concat(t["doc_id"], F.lit(":"), t["n"].cast("string"))), ",")
    left = singles.join(F.broadcast(batch.select("rule_id")), "rule_id", "left_anti")  # a row a rule, a few dozen
    return systemic, batch.select("rule_id", "findings", "documents", named.alias("top_docs")), left


def run_totals(runs: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """runs with their findings and verdicts, 0 where there are none."""
    f = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"))
    v = verdicts.groupBy(F.substring_index("finding_key", "|", 1).alias("run_id")).agg(F.count(F.lit(1)).alias("judged"))
    return runs.join(f, "run_id", "left").join(v, "run_id", "left").fillna(0, ["findings", "judged"])


def dashboard(reviewed_: DataFrame) -> DataFrame:
    """One row: total, judged, todo, grave (CRITICAL and HIGH) and the share of true verdicts among true and false ones."""
    true, false = F.count_if(F.col("verdict") == "true"), F.count_if(F.col("verdict") == "false")
    return reviewed_.agg(F.count(F.lit(1)).alias("total"), F.count("verdict").alias("judged"), F.count_if(F.col("verdict").isNull()).alias("todo"), F.count_if(F.col("level").isin("CRITICAL", "HIGH")).alias("grave"), F.round(F.when(true + false > 0, true / (true + false)), 4).alias("true_rate"))


def evaluation(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, unjudged, recall, precision over distinct (doc_id, page_no, rule_id); gold has kind positive or negative."""
    key = ["doc_id", "page_no", "rule_id"]
    p = predicted.select(*key).distinct().withColumn("said", F.lit(True))
    g = gold.groupBy(*key).agg(F.bool_or(F.col("kind") == "positive").alias("positive"), F.bool_or(F.col("kind") == "negative").alias("negative"))
    both = p.join(g, key, "full")
    said = F.coalesce("said", F.lit(False))
    pos, neg = F.coalesce("positive", F.lit(False)), F.coalesce("negative", F.lit(False))
    n = both.agg(F.count_if(said & pos).alias("tp"), F.count_if(said & neg).alias("fp"), F.count_if(~said & pos).alias("fn"), F.count_if(said & ~pos & ~neg).alias("unjudged"))
    return n.select("*", F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), 4).alias("recall"), F.round(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), 4).alias("precision"))


def merged_gold(verdicts: DataFrame) -> DataFrame:
    """kind of each gold key after all verdicts (decided_at, finding_key): the last true or false decides; unsure adds a mark that a later decision takes away."""
    order = F.struct("decided_at", "finding_key")
    firm = F.col("verdict").isin("true", "false")
    key = ["doc_id", "page_no", "rule_id"]
    # dealt by key before the aggregate, which sorts as its values aren't of fixed width: else a task sorts them a second time beside the sort that made the rows
    last = verdicts.repartition(*key).groupBy(*key).agg(F.max(F.when(firm, F.struct(order.alias("o"), F.col("verdict").alias("v")))).alias("firm"), F.max(F.when(F.col("verdict") == "unsure", order)).alias("unsure"))
    kept = last.select("doc_id", "page_no", "rule_id", F.col("firm.v").alias("v"), (F.col("unsure").isNotNull() & (F.col("firm").isNull() | (F.col("unsure") > F.col("firm.o")))).alias("unsure"))
    return kept.select("doc_id", "page_no", "rule_id", F.when(F.col("v") == "true", "positive").when(F.col("v") == "false", "negative").alias("kind"), "unsure")


def numbered(findings: DataFrame) -> DataFrame:
    """findings with no, from 1 by severity, document, page and key."""
    columns = [c for c in findings.columns if c != "no"]
    ranked = findings.select(*columns, level_rank(F.col("level"), 3).alias("_rank"))
    return ranges.row_numbers(ranked, "_rank", "doc_id", "page_no", "finding_key").select(F.col("no").cast("int"), *columns)


def ledger(findings: DataFrame) -> DataFrame:
    """The exported list: a number from 1 by severity, and text fields made safe for CSV."""
    flat = lambda x: F.regexp_replace(x, "[\r\n]", " ")
    quoted = lambda x: F.when(x.rlike('[,"]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return numbered(findings).select("no", "finding_key", "level", quoted(flat(F.col("message"))).alias("message"))
