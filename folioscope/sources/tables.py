"""Readers: driver tables, page scans from folders, JSON gold sets and reviews, CSV and text sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Suffixes of page images; PDFs are documents of their own.
IMAGES = ("tif", "tiff", "jpg", "jpeg", "png", "bmp")

GOLD = "findings array<struct<doc_id:string,page_no:int,rule_id:string,note:string,reviewer:string>>, false_positives array<struct<doc_id:string,page_no:int,rule_id:string>>, unsure array<struct<doc_id:string,page_no:int,rule_id:string>>, reviewed_pages array<array<string>>"
REVIEW = "reviewer string, adjudications array<struct<verdict:string,doc_id:string,page_no:int,rule_id:string,note:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_pages(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, page_no, source, length: every page image below root. A folder's images, sorted by name, are one document;
    files that can't be decoded keep their number, so gaps are possible. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    parts = F.split("path", "/")
    named = files.select("path", "length", F.element_at(parts, -2).alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"))
    images = named.where(F.col("suffix").isin(*IMAGES))
    number = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    return images.select("doc_id", number.alias("page_no"), F.col("path").alias("source"), "length")


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """One page image as a document of its own: doc_id, page_no, source, length. Any other kind of file is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, _, suffix = name.rpartition(".")
    if suffix.lower() not in IMAGES:
        raise ValueError(f"no page image: {path}")
    return spark.read.format("binaryFile").load(path).select(F.lit(stem).alias("doc_id"), F.lit(1).alias("page_no"), F.col("path").alias("source"), "length")


def page_list(pages: str = "pages", start: str = "start_page", end: str = "end_page") -> str:
    """SQL for a unit's pages: the JSON list of page numbers where it is one and not empty, else all from its first to its last page."""
    listed = f"filter(from_json({pages}, 'array<int>'), p -> p IS NOT NULL)"
    return f"if(size({listed}) > 0, {listed}, if({start} <= {end}, sequence(CAST({start} AS INT), CAST({end} AS INT)), CAST(array() AS array<int>)))"


def page_counts(pages: DataFrame) -> DataFrame:
    """doc_id, page_count: documents of one name from several folders add up."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


def read_gold(spark: SparkSession, *paths: str) -> DataFrame:
    """kind (positive, negative, unsure), doc_id, page_no, rule_id of a gold set."""
    gold = spark.read.schema(GOLD).option("multiLine", True).json(list(paths))
    key = lambda c, kind: gold.select(F.explode(c).alias("k")).select(F.lit(kind).alias("kind"), "k.doc_id", "k.page_no", "k.rule_id")
    return key("findings", "positive").union(key("false_positives", "negative")).union(key("unsure", "unsure"))


def read_reviewed_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id, page_no: the pages that a gold set was made from, those without any finding, too."""
    gold = spark.read.schema(GOLD).option("multiLine", True).json(list(paths))
    return gold.select(F.explode("reviewed_pages").alias("p")).select(F.col("p")[0].alias("doc_id"), F.col("p")[1].cast("int").alias("page_no")).distinct()


def page_at(pages: DataFrame, doc_id: str, page_no: int) -> DataFrame:
    """One page of scan_pages(), by document and number."""
    return pages.where((F.col("doc_id") == doc_id) & (F.col("page_no") == page_no))


def read_reviews(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_no, seq, reviewer, verdict, doc_id, page_no, rule_id, note; later files and entries win."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.schema(REVIEW).option("multiLine", True).json(path)
        rows = one.select(F.lit(i).alias("file_no"), "reviewer", F.posexplode("adjudications").alias("seq", "a")).select("file_no", "seq", "reviewer", "a.*")
        out = rows if out is None else out.union(rows)
    return out


def uncached(pages: DataFrame, cached: DataFrame) -> DataFrame:
    """The pages whose hash has no recognised lines yet."""
    return pages.join(cached.select("page_hash").distinct(), "page_hash", "left_anti")


def _check(lines: str = "lines") -> Column:
    return F.sha1(F.concat_ws("|", "page_hash", F.to_json(lines, {"ignoreNullFields": "false"})))


def read_cache(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    """page_hash, lines of a cache written by recognised(). Rows whose check sum doesn't fit and files that can't be read count as absent."""
    schema = T.StructType([T.StructField("page_hash", T.StringType()), T.StructField("lines", kind), T.StructField("check", T.StringType())])
    try:
        rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException:  # no cache yet
        return spark.createDataFrame([], schema).drop("check")
    return rows.where(F.col("check") == _check()).groupBy("page_hash").agg(F.first("lines").alias("lines"))


def recognised(pages: DataFrame, path: str, recognise: Callable[[DataFrame], DataFrame], kind: str) -> DataFrame:
    """pages (with page_hash) with their lines, of SQL type `kind`: from the cache at path where it has them, else from recognise().

    recognise() takes pages of which no two have the same hash and returns page_hash and lines; what it finds is added to the
    cache before it is read, so that a second run recognises nothing. Pages without a hash have null lines."""
    spark, type_ = pages.sparkSession, T._parse_datatype_string(kind)
    new = uncached(pages.where("page_hash IS NOT NULL"), read_cache(spark, path, type_)).dropDuplicates(["page_hash"])
    found = recognise(new).select("page_hash", F.col("lines").cast(type_).alias("lines"))
    found.withColumn("check", _check()).write.mode("append").parquet(path)
    return pages.join(read_cache(spark, path, type_), "page_hash", "left")


def log_tail(spark: SparkSession, path: str, lines: int = 400) -> DataFrame:
    """line_no, value: the last lines of one text file, in order. Blocks of a file are numbered by where they start, so numbers grow along it."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    text = spark.read.text(path).select("value", at.alias("at"))
    return text.orderBy(F.desc("at")).limit(lines).orderBy("at").select(F.col("at.n").alias("line_no"), "value")
