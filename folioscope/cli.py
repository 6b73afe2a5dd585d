"""python -m folioscope.cli: audit, eval, gold and export over tables on any storage that Spark reads.

    audit PAGES OUT [--run ID] [--rules A01,A02] [--catalog FILE] [--no-packs] [--units OUT]
                                                   findings of nested page rows, as a run's partition under OUT: page rules,
                                                   and where pages have lines and cells units and their rules
    eval FINDINGS GOLD                             recall and precision against a gold set in JSON
    gold OUT REVIEW...                             verdict files folded into a gold set in JSON
    export FINDINGS OUT                            a ledger as CSV text
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import findings as f
from .operators import audit as flow
from .operators import store
from .plans import catalog
from .sources import rulefiles, sinks, tables


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    rules, pages = a.rules.split(",") if a.rules else (), spark.read.parquet(a.pages)
    if a.limit:  # the first pages by archive and number
        pages = pages.orderBy("doc_id", "page_no").limit(a.limit)
    book, forms, _ = rulefiles.load(a.catalog, None if a.no_packs else "auto") if a.catalog else (catalog.BOOK, None, [])
    if rules or "cells" not in pages.columns:
        found = flow.page_findings(pages, *rules, book=book)
    else:
        found, units = flow.audit(pages, book=book, forms=forms, long_archives=a.long_archives)
        if a.units:
            store.import_run(units.withColumn("run_id", F.lit(a.run)), a.units)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "rule_id", "message", "box"))
    store.import_run(f.with_key(found.withColumn("seq", seq).withColumn("run_id", F.lit(a.run))), a.out)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    row = f.evaluation(spark.read.parquet(a.findings), tables.read_gold(spark, a.gold)).first()
    print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))


def gold(spark: SparkSession, a: argparse.Namespace) -> None:
    reviews = tables.read_reviews(spark, a.reviews)
    order = F.struct(F.lpad(F.col("file_no").cast("string"), 9, "0"), F.lpad(F.col("seq").cast("string"), 9, "0"))
    keyed = reviews.withColumn("decided_at", F.concat_ws("|", *[order.getField(c) for c in ("col1", "col2")])).withColumn("finding_key", F.col("decided_at"))
    sinks.gold_json(f.merged_gold(keyed)).coalesce(1).write.mode("overwrite").text(a.out)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.findings)
    sinks.ledger_csv(f.numbered(rows)).coalesce(1).write.mode("overwrite").text(a.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(required=True)
    for run, *names in ((audit, "pages", "out"), (evaluate, "findings", "gold"), (gold, "out"), (export, "findings", "out")):
        p = sub.add_parser("eval" if run is evaluate else run.__name__)
        for n in names:
            p.add_argument(n)
        if run is audit:
            p.add_argument("--run", default="run")
            p.add_argument("--rules", default="")
            p.add_argument("--catalog", default="")
            p.add_argument("--no-packs", action="store_true")
            p.add_argument("--units", default="")
            p.add_argument("--limit", type=int, default=0, help="audit so many pages at most")
            p.add_argument("--long-archives", action="store_true", help="cut archives at pages 1")
        if run is gold:
            p.add_argument("reviews", nargs="+")
        p.set_defaults(run_=run)
    a = parser.parse_args(argv)
    a.run_(spark or SparkSession.builder.appName("folioscope").getOrCreate(), a)


if __name__ == "__main__":
    main()
