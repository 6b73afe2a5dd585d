"""Order within and over large groups without one task for a group: running values by buckets, row numbers by ranges, top rows by salt.

A running value is the bucket's own running value plus what the buckets before it carry in; only the buckets of a group meet in
one task, one row for WIDTH places. Row numbers come from range partitions: rows are sorted by ranges and written with their
place in their partition, and the counts of the partitions give each its offset. Top rows are first taken within salted parts
of a group. All three give what a window over the whole group would.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places (page numbers) in a bucket.
WIDTH = 4096
#: Salted parts of a group.
PARTS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a plain local session a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, key: str, at: str, value: Column, name: str, *, how: str = "sum", own: bool = True, width: int = WIDTH) -> DataFrame:
    """df with the sum or the maximum (how) of value over the rows of a key up to the place `at`, a whole number; own: with the row's own value. Null where there is none. A null key is a key."""
    fold = {"sum": F.sum, "max": F.max}[how]
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest}[how]
    marked = df.withColumns({"_bucket": F.floor(F.col(at) / width), "_value": value})
    inside = Window.partitionBy(key, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    buckets = marked.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(fold("_value").alias("_total"))
    carried = buckets.select("_key", "_of", fold("_total").over(before).alias("_carried")).where("_carried IS NOT NULL")
    joined = marked.withColumn("_inside", fold("_value").over(inside)).join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of")), "left")
    return joined.withColumn(name, both(F.col("_inside"), F.col("_carried"))).drop("_bucket", "_value", "_key", "_of", "_carried", "_inside")


def row_numbers(df: DataFrame, *order: str | Column, name: str = "no") -> DataFrame:
    """df with numbers from 1 in this order. Rows that are equal in it are numbered in any order."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_id"))
    rows = written(rows, "numbered").withColumn("_part", F.shiftright("_id", 33))
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row a partition
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint"))
    place = F.col("_offset") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(starts, "_part").withColumn(name, place).drop("_part", "_id", "_offset")


def top(df: DataFrame, key: str, n: int, *order: Column, spread: str, name: str = "at", parts: int = PARTS) -> DataFrame:
    """The first n rows of each key in this order, with their place; `spread` is a column that deals a key's rows out."""
    some = df.withColumn(name, F.row_number().over(Window.partitionBy(key, F.pmod(F.hash(spread), F.lit(parts))).orderBy(*order))).where(F.col(name) <= n)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= n)
