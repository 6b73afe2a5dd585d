"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Method. A text becomes some twenty statistics (lengths, shares of character kinds, repetition, entropy). They are
standardised and mapped to cosines whose expected product is a Gaussian kernel. Every partition adds up its own normal
equations; sums of partitions are added again on a few tasks, and the driver solves one small system. Raw scores of the
labelled rows kept apart for it are counted in bins, and pooled adjacent violators turn them into probabilities.

Only labels of rows whose crc32(doc_id as text) mod 4 isn't 2 (`held_out`) are learnt from.
All labelled rows count; nothing is sampled. Labels, lang, source and doc_id are no inputs of a score.

Defined results. Null text is scored as an empty text; every row gets a score. Labels with null quality or doc_id are
left out; a document with several labels counts once for each. Without any label nothing speaks against a document:
score 1. Repeated rows get equal scores. Extra columns pass through `score_documents` untouched; `score` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_chunks, columns, discard, settle

FOURIER, GAMMA, RIDGE, BINS, FOLDS, SEED = 128, 0.02, 1e-3, 1000, 5, 7
#: Score from which a document is good.
CUT = 0.7

STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "space", "line_breaks", "stops", "bangs", "marks", "bars", "other_signs",
    "high_bytes", "distinct_words", "repeats", "ends_with_sign", "lone_signs", "entropy",
)

_KIND = np.zeros((256, 10), dtype=np.float64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [
        "A" <= _c <= "Z", "0" <= _c <= "9", _c in " \t\r\x0b\x0c", _c == "\n", _c in ".,;:", _c == "!", _c in "#$%&*", _c in "|<>", 0x21 <= _b < 0x7F and not _c.isalnum() and _c not in ".,;:!#$%&*|<>", _b >= 0x80,
    ]
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_SIGN = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])
_STRONG = np.isin(np.arange(256), list(b"!#$%&*|<>"))


def statistics(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text, in the order of STATISTICS."""
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return [float(np.log1p(n)), *[0.0] * (len(STATISTICS) - 1)]
    raw = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = counts @ _KIND / n
    space = _SPACE[raw]
    ends = np.flatnonzero(~space & np.append(space[1:], True))
    starts = np.flatnonzero(~space & np.insert(space[:-1], 0, True))
    sizes = ends - starts + 1
    p = counts[counts > 0] / n
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(sizes.mean()), float(np.log1p(sizes.max())), *kinds.tolist(),
        len(set(words)) / w, repeats / w, float(_STRONG[raw[ends]].mean()), float((_SIGN[raw[starts]] & (sizes == 1)).mean()), float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    at: np.ndarray
    chance: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, np.sqrt(2 * GAMMA), (z.shape[1], FOURIER))
        shift = rng.uniform(0, 2 * np.pi, FOURIER)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / FOURIER) * np.cos(z @ w + shift)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.ones(len(x))
        return np.clip(np.interp(self.raw(x), self.at, self.chance), 0, 1)


def held_out(doc_id: Column, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == remainder, F.lit(False))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and f, the statistics, for every row."""

    def measure(batches):
        for batch in batches:
            for first, texts in byte_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f array<double>")


def _grid(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, remainder: int = 2) -> Model:
    """stats: what document_statistics() gives, from a table that can be read again; labels: doc_id, quality."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"), remainder))
    rows = settle(stats.join(known, "doc_id").select("f", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    m = len(STATISTICS)
    moments = rows.agg(F.count(F.lit(1)), *[g(F.col("f")[i]) for g in (F.avg, F.stddev_pop) for i in range(m)]).first()
    model = Model(np.zeros(m), np.ones(m), None, np.zeros(1), np.ones(1))
    if moments[0]:
        model.mean, model.scale = np.array(moments[1 : 1 + m], dtype=float), np.maximum(np.array(moments[1 + m :], dtype=float), 1e-6)
        wide = 1 + m + FOURIER
        half = np.triu_indices(wide)
        size = len(half[0]) + wide

        def equations(batches):
            sums = np.zeros((FOLDS, size))
            for batch in batches:
                z, y = model.features(_grid(batch.column("f"))), batch.column("y").to_numpy(zero_copy_only=False)
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                for k in range(FOLDS):
                    mine = z[fold == k]
                    sums[k] += np.concatenate(((mine.T @ mine)[half], mine.T @ y[fold == k]))
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        def added(batches):
            total = np.zeros(FOLDS * size)
            for batch in batches:
                for s in batch.column("sums"):
                    total += np.frombuffer(s.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def solved(sums: np.ndarray) -> np.ndarray:
            a = np.zeros((wide, wide))
            a[half] = sums[:-wide]
            a = a + a.T - np.diag(np.diag(a))
            ridge = RIDGE * a[0, 0] * np.eye(wide)
            ridge[0, 0] = 0
            return np.linalg.solve(a + ridge + 1e-9 * np.eye(wide), sums[-wide:])

        sums = rows.mapInArrow(equations, "sums binary")
        for tasks in _levels(len(rows.inputFiles())):
            sums = sums.repartition(tasks).mapInArrow(added, "sums binary")
        parts = sums.collect()
        folds = np.sum([np.frombuffer(bytes(r[0])) for r in parts], axis=0).reshape(FOLDS, size)
        model.weights = solved(folds.sum(axis=0))
        without = np.stack([solved(folds.sum(axis=0) - f) for f in folds])  # a row is judged by the sums of the other folds

        def raw(batches):
            for batch in batches:
                z, fold = model.features(_grid(batch.column("f"))), batch.column("fold").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array((z * without[fold]).sum(axis=1)), batch.column("y")], names=["raw", "y"])

        judged = rows.mapInArrow(raw, "raw double, y double")
        bins = judged.groupBy(F.floor(F.greatest(F.least("raw", F.lit(2.0)), F.lit(-1.0)) * BINS).alias("bin")).agg(F.avg("raw").alias("at"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))
        model.at, model.chance = pooled([(r["at"], r["n"], r["good"]) for r in bins.orderBy("bin").collect()])
    discard(rows)
    return model


def _levels(parts: int) -> list[int]:
    """Tasks of each round of adding: a sixteenth of the round before, down to four."""
    out = [max(4, -(-parts // 16))]
    while out[-1] > 4:
        out.append(max(4, -(-out[-1] // 16)))
    return out


def pooled(bins: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: the first and last score of each pool, and its share of good rows."""
    pools: list[list[float]] = []
    for at, n, good in bins:
        pools.append([at, at, n, good])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            lo, hi = pools[-2], pools.pop()
            lo[1:] = [hi[1], lo[2] + hi[2], lo[3] + hi[3]]
    at = np.array([x for p in pools for x in (p[0], p[1])])
    return at, np.array([p[3] / p[2] for p in pools for _ in range(2)])


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with one more column, the score; no exchange."""
    keep = [c for c in docs.columns if c != column]
    rows = docs.select(F.struct(*columns(keep)).alias("row"))  # one column, as Python functions over a table resolve dots in names

    def score(batches):
        for batch in batches:
            row = batch.column("row")
            for first, texts in byte_chunks(row.field("text")):
                s = model.score(np.array([statistics(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([row.slice(first, len(texts)), pa.array(s, pa.float64())], names=["row", "score"])

    scored = rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("score").alias(column))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score at least cut. Columns and their order stay."""
    stats = settle(document_statistics(docs), "statistics")
    model = fit(stats, labels)
    name = next(f"score_{i}" for i in range(len(docs.columns) + 1) if f"score_{i}" not in docs.columns)
    return score_documents(docs, model, name).where(F.col(name) >= cut).select(*columns(docs.columns))


def op3_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = settle(document_statistics(docs), "statistics")
    model = fit(stats, labels)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_grid(batch.column("f"))), pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(score, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
