"""Shared helpers: scratch tables in the cluster's shared folder, byte chunks, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on at a time; bounds a worker's memory.
CHUNK_BYTES = 4 << 20

#: ASCII white space, the only word breaks of the near-duplicate operators.
SPACE_WORD = re.compile(rb"[^\x20\x09-\x0d]+")

#: Word bytes of the decontamination rule, A-Z lowered; everything else becomes a space.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and backticks included."""
    return [F.col(f"`{name.replace('`', '``')}`") for name in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a plain local session a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: the lineage ends at reliable files. The table goes with discard(), else when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._folioscope_path = path
    return back


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a written path deleted when the driver ends, or by scratch()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    for paths in _OPEN:
        paths.append(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that settle() wrote, once nothing that is still to run reads it."""
    path = getattr(df, "_folioscope_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that settle() wrote within it, but for those that the caller takes from the list."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.remove(paths)
        for path in paths:
            _delete(spark, path)


def as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of consecutive rows with about limit bytes; null counts as empty."""
    raw = as_bytes(column)
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_pylist()
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, [x or b"" for x in raw.slice(first, i - first).to_pylist()]
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, [x or b"" for x in raw.slice(first).to_pylist()]
