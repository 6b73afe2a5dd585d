"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

Method. Every benchmark item becomes windows of `n` consecutive words (an item with fewer words is one window).
Words get small integers, windows a 64-bit polynomial hash over those integers. The hash set is broadcast after its
size was counted, in words and in bytes; executors roll the same hash over document words, look hits up by binary search,
and verify each hit word by word (a word has one integer, so equal integers are equal words). Hit words are then reported,
cut out, or the document is dropped.

A benchmark of more than `max_windows` words or MAX_BYTES of text isn't brought to the driver. A bitmap of fixed size over
the hashes of its windows is broadcast instead; document windows that pass it, of the lengths that the benchmark has, meet
the benchmark's distinct windows in a shuffle join on the window's text, which is the verification. Hot windows stand once
on the benchmark's side, so that an adaptive join can split the documents' side.

Defined results. Null or empty text: no words, clean. Null benchmark text: no windows. Empty benchmark: all clean.
Repeated documents: a row each. Repeated items: each counts under its item_id. Null item_id is left out of item lists
but its windows count as hits. Extra columns pass through untouched; report columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, byte_chunks, settle

#: Broadcast no benchmark of more words (under 100 bytes each in the index, with its window and its owners) and text than this.
MAX_WINDOWS, MAX_BYTES = 1_000_000, 32 << 20
#: Bits of the bitmap over the windows of a larger benchmark (32 MB), and how many bits a window sets.
BITMAP_BITS, PROBES = 28, 2
#: Drop a document when at least this share of its words is benchmark text; below, cut the spans out.
DROP_SHARE = 0.5

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("clean_text", T.StringType()),
    ]
)
_ARROW = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))), ("clean_text", pa.string())])

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULTIPLIER = 0x9E3779B97F4A7C15


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class WindowIndex:
    """The benchmark's windows: per window length sorted hashes, the words and, as offsets into one array, the owners."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.n, self.vocabulary, self.items = n, {}, [None if i is None else str(i) for i, _ in items]
        by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for owner, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words((text or "").encode())], dtype=np.int32)
            if k := min(n, len(ids)):
                by_length[k].append((owner, np.lib.stride_tricks.sliding_window_view(ids, k)))
        self.tables = []
        for k, parts in sorted(by_length.items()):
            grid = np.concatenate([w for _, w in parts])
            owner = np.repeat(np.array([o for o, _ in parts], dtype=np.int32), [len(w) for _, w in parts])
            windows, which = np.unique(grid, axis=0, return_inverse=True)
            hashes = self.roll(windows.T)
            order = np.argsort(hashes, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            held = np.unique(np.stack([place[which.ravel()], owner], axis=1), axis=0)
            self.tables.append((k, hashes[order], windows[order], np.searchsorted(held[:, 0], np.arange(len(order) + 1)), held[:, 1].astype(np.int32)))

    @staticmethod
    def roll(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1], dtype=np.uint64)
        for c in columns:
            out = out * np.uint64(_MULTIPLIER) + c.astype(np.uint64)
        return out

    def hits(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """(positions, windows, length, offsets, owners) of all verified occurrences in ids; 0 is no benchmark word."""
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        found = []
        for k, hashes, grid, offsets, owners in self.tables:
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            rolled = self.roll(np.stack([ids[at + j] for j in range(k)]))
            lo, hi = np.searchsorted(hashes, rolled, "left"), np.searchsorted(hashes, rolled, "right")
            for step in range(int((hi - lo).max(initial=0))):  # over 1 only where two windows share a hash
                some = np.flatnonzero(lo + step < hi)
                rows = lo[some] + step
                same = (np.stack([ids[at[some] + j] for j in range(k)], axis=1) == grid[rows]).all(axis=1)
                if same.any():
                    found.append((at[some][same], rows[same], k, offsets, owners))
        return found


def _scan(index: WindowIndex, texts: list[bytes], cut: bool) -> list[dict]:
    get, pieces, sizes = index.vocabulary.get, [], []
    for text in texts:
        words = split_words(text)
        sizes.append(len(words))
        pieces.extend(map(get, words, repeat(0)))
        pieces.append(0)  # no window crosses documents
    ids = np.array(pieces, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)))
    edge, items = np.zeros(len(ids) + 1, dtype=np.int64), defaultdict(set)
    for at, rows, k, offsets, owners in index.hits(ids):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
        met = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, rows], axis=1), axis=0)
        for doc, row in met.tolist():
            items[doc].update(owners[offsets[row] : offsets[row + 1]].tolist())
    hit = np.cumsum(edge[:-1]) > 0
    out = []
    for doc, (n, text) in enumerate(zip(sizes, texts, strict=True)):
        first = int(starts[doc])
        named = {index.items[i] for i in items[doc]} - {None} if doc in items else ()
        out.append(_line(text, n, hit[first : first + n], sorted(named), cut))
    return out


def _line(text: bytes, n: int, hit: np.ndarray, items: list[str], cut: bool) -> dict:
    """A document's report from the marks of its words."""
    n_hit = int(hit.sum())
    row = {"n_words": n, "n_hit": n_hit, "n_items": len(items), "items": items, "spans": []}
    if n_hit:
        row["spans"] = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2).tolist()
    if cut:
        row["clean_text"] = _without(text, row["spans"]).decode("utf-8", "replace") if n_hit else None
    return row


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    """text without the words of spans and what stands between them."""
    where = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : where[a][0]])
        at = where[b - 1][1]
    return b"".join([*out, text[at:]])


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, k, window: the windows as text, words joined by a space."""

    def windows(batches):
        for batch in batches:
            owner = batch.column("item_id")
            for first, texts in byte_chunks(batch.column("text")):
                for i, text in enumerate(texts):
                    words = split_words(text)
                    k = min(n, len(words))
                    count = len(words) - k + 1 if k else 0
                    for at in range(0, count, 10_000):
                        some = [b" ".join(words[j : j + k]).decode("utf-8", "replace") for j in range(at, min(at + 10_000, count))]
                        owners = pa.array([owner[first + i].as_py()] * len(some), owner.type)
                        yield pa.RecordBatch.from_arrays([owners, pa.array([k] * len(some), pa.int32()), pa.array(some, pa.string())], names=["item_id", "k", "window"])

    return benchmark.select("item_id", "text").mapInArrow(windows, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, k int, window string")


def _words_column(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _reported(docs: DataFrame, benchmark: DataFrame, n: int, cut: bool, max_windows: int) -> DataFrame:
    """row (a struct of the columns of docs) and report (a struct of REPORT): no name of docs meets one of these."""
    bench = benchmark.select("item_id", "text")
    words, size = bench.select(F.size(_words_column(F.col("text"))).alias("w"), F.octet_length("text").alias("b")).agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    fields = [f for f in REPORT.fields if cut or f.name != "clean_text"]
    schema = T.StructType([*rows.schema.fields, T.StructField("report", T.StructType(fields))])
    kind = pa.struct([_ARROW.field(f.name) for f in fields])
    if words > max_windows or size > MAX_BYTES:
        return _by_join(rows, bench, n, cut, schema, kind)
    index = docs.sparkSession.sparkContext.broadcast(WindowIndex([(r[0], r[1]) for r in bench.collect()], n))

    def scan(batches):
        for batch in batches:
            row = batch.column("row")
            for first, texts in byte_chunks(row.field("text")):
                yield pa.RecordBatch.from_arrays([row.slice(first, len(texts)), pa.array(_scan(index.value, texts, cut), kind)], names=["row", "report"])

    return rows.mapInArrow(scan, schema)


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """A hash for each window of k words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.full(max(0, len(h) - k + 1), k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_MULTIPLIER) + h[j : j + len(out)]
    return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    """The places that windows have in the bitmap."""
    return [((hashes >> np.uint64(64 - BITMAP_BITS - 8 * i)) & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64) for i in range(PROBES)]


def _bitmap(windows: DataFrame) -> np.ndarray:
    """2^BITMAP_BITS bits, those of the windows set; the driver receives that many bits at most."""

    def places(batches):
        for batch in batches:
            for window, k in zip(batch.column("window").to_pylist(), batch.column("k").to_pylist(), strict=True):
                at = np.concatenate(_bits(_hashes(window.encode().split(b" "), k)))
                yield pa.RecordBatch.from_arrays([pa.array(at + 1, pa.int64())], names=["at"])  # buckets count from 1

    parts = windows.mapInArrow(places, "at bigint").groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for r in parts:
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        first = (r["b"] - 1) * len(part)
        out[first : first + len(part)] |= part[: len(out) - first]
    return out


def _by_join(rows: DataFrame, bench: DataFrame, n: int, cut: bool, schema: T.StructType, kind: pa.StructType) -> DataFrame:
    """The same report for a benchmark of any size: windows of both sides meet in a shuffle join."""
    owned = settle(benchmark_windows(bench, n), "windows")
    windows = settle(owned.select("k", "window").distinct(), "windows")
    lengths = [r["k"] for r in windows.select("k").distinct().orderBy("k").collect()]  # n at most
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(windows))
    numbered = settle(rows.withColumn("n", F.monotonically_increasing_id()), "numbered")  # numbers hold only once written

    def grams(batches):
        for batch in batches:
            number = batch.column("n")
            for first, texts in byte_chunks(batch.column("text")):
                for i, text in enumerate(texts):
                    words = split_words(text)
                    out = []
                    for k in lengths:
                        hashes = _hashes(words, k)
                        likely = np.ones(len(hashes), dtype=bool)
                        for at in _bits(hashes):
                            likely &= (bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                        out += [(int(at), k, b" ".join(words[at : at + k])) for at in np.flatnonzero(likely)]
                    for at in range(0, len(out), 10_000):
                        some = out[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([number[first + i].as_py()] * len(some), pa.int64()), pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int32()), pa.array([x[2].decode("utf-8", "replace") for x in some], pa.string())],
                            names=["n", "at", "k", "window"],
                        )

    found = numbered.select("n", F.col("row.text").alias("text")).mapInArrow(grams, "n bigint, at int, k int, window string")
    hits = settle(found.join(windows, ["k", "window"]), "hits")
    marks = hits.groupBy("n").agg(F.collect_list(F.struct("at", "k")).alias("marks"))  # a document's own words bound its marks
    items = hits.select("n", "k", "window").distinct().join(owned, ["k", "window"]).groupBy("n").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    wide = numbered.join(marks, "n", "left").join(items, "n", "left").select("row", "marks", "items")

    def report(batches):
        for batch in batches:
            row = batch.column("row")
            for first, texts in byte_chunks(row.field("text")):
                out = []
                for i, text in enumerate(texts):
                    marks, size = batch.column("marks")[first + i].as_py() or [], len(split_words(text))
                    edge = np.zeros(size + 1, dtype=np.int64)
                    np.add.at(edge, [m["at"] for m in marks], 1)
                    np.add.at(edge, [m["at"] + m["k"] for m in marks], -1)
                    out.append(_line(text, size, np.cumsum(edge[:-1]) > 0, batch.column("items")[first + i].as_py() or [], cut))
                yield pa.RecordBatch.from_arrays([row.slice(first, len(texts)), pa.array(out, kind)], names=["row", "report"])

    return wide.mapInArrow(report, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, cut: bool = False, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, spans (of word numbers, end exclusive) and, if cut, clean_text (null where nothing is cut)."""
    seen = _reported(docs, benchmark, n, cut, max_windows)
    return seen.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in REPORT.names], "report.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, drop_share: float = DROP_SHARE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without benchmark passages: spans are cut out; a document that is benchmark text by drop_share or more goes. Columns and their order stay."""
    seen = _reported(docs, benchmark, n, True, max_windows)
    kept = seen.where((F.col("report.n_hit") == 0) | (F.col("report.n_hit") < drop_share * F.col("report.n_words")))
    return kept.select(*[F.coalesce("report.clean_text", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    report = contamination(docs.select("doc_id", "text"), benchmark, n=10)
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 10) -> list[tuple]:
    """The contract word by word, for tests."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for item_id, item in items:
            w = split(item)
            k = min(n, len(w))
            for i in range(len(w) - k + 1 if k else 0):
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == w[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ORACLE = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, CAST(least(10, len(w)) AS BIGINT) AS k, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS i FROM bw WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM starts
), lengths AS (SELECT DISTINCT k FROM windows
), places AS (
  SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM dw CROSS JOIN lengths WHERE len(w) >= k
), hits AS (
  SELECT DISTINCT doc_id, i, p.k, item_id FROM (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM places) p JOIN windows USING (k, g)
), marked AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""
