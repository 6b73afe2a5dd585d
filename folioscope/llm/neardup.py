"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Method. A document's set is its distinct word shingles. Documents with the same set form a class, of which the smallest
doc_id stands for all, so exact copies cost nothing further. A class gets a sketch of t coordinates: in round i < t every
shingle is hashed to a value and to one of the t bins, in round t + j to bin j; a bin keeps its smallest (round, value).
A set stops after the first round that leaves no bin empty, and round 2t at the latest fills every bin; the share of
equal coordinates is concentrated about the similarity as with t independent functions. Bands of coordinates become
bucket keys; t follows from the wished bound on missed links. Within a bucket no pairs are listed: every member meets
the bucket's leader; these pairs pass a filter on sizes and sketches (six standard deviations below the threshold) and are
confirmed on the full sets; connected components are formed. Buckets that still hold several components are gathered into
clusters, and in a cluster the members outside its largest component meet all others of a size that allows a link (size
classes a threshold's ratio wide: only neighbours can link): block by block, blocks bounded by their shingles, with exact
intersections counted through an index of the block's shingles. Only links leave a block.

Links within a component that add nothing to it aren't looked for: components and kept documents are what is returned.
All state (links, labels, sets of candidates) stays in tables in the shared folder; the driver gets counts only.

Defined results. Null or empty text, or text without words: empty set, linked with nothing, kept. Fewer words than a
shingle takes: the whole sequence is the one shingle. Repeated rows are copies and get the same component; all rows
that carry the component's smallest doc_id are kept. Rows with a null doc_id take no part: null component, kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, columns, discard, settle

#: Bound on the chance that a link at the threshold shares no bucket.
MISS = 1e-8
#: Shingles of a block: a cluster is cut into PIECES blocks, but into blocks of no fewer and no more than these.
PIECES, LEAST_BLOCK, MOST_BLOCK = 16, 16_384, 1 << 20
#: Shingles from which on a cluster is taken bucket by bucket.
HUGE_CLUSTER = PIECES * MOST_BLOCK
#: Rows to a file of the small tables that components() goes through.
FILE_ROWS = 200_000
#: Words whose hashes a worker remembers.
CACHE_WORDS = 400_000

_GOLDEN = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(rows of a band, bands)."""
    rows = 5 if threshold >= 0.85 else 4 if threshold >= 0.7 else 3
    return rows, math.ceil(math.log(miss) / math.log(1 - threshold**rows))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), dtype=np.uint64)
    for j in range(min(k, len(h))):
        out = _mix(out * np.uint64(_GOLDEN) + h[j : j + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each set; the sets aren't empty."""
    table = np.full(len(sets) * t, _EMPTY, dtype=np.uint64)
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        v = _mix(items + np.uint64((i + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
        bins = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(table, owner * t + bins, np.uint64(i << 32) | (v & np.uint64(0xFFFFFFFF)))
        short = (table.reshape(-1, t) == _EMPTY).any(axis=1)
        if not short.any():
            break
        rest = short[owner]
        items, owner = items[rest], owner[rest]
    return table.reshape(-1, t)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """doc_id, class (16 bytes, null for an empty set), n, keys (one bucket key a band) and sketch (16 bits a coordinate)."""

    def sign(batches):
        for batch in batches:
            for first, texts in byte_chunks(batch.column("text")):
                sets = [shingle_set(t, k) for t in texts]
                full = [s for s in sets if len(s)]
                coords = sketches(full, rows * bands)
                keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(full), axis=0) * np.uint64(_GOLDEN)
                grid = coords.reshape(len(full), bands, rows)
                for j in range(rows):
                    keys = _mix(keys * np.uint64(0xD6E8FEB86659FD93) + grid[:, :, j])
                short = (_mix(coords) >> np.uint64(48)).astype("<u2")
                place = iter(range(len(full)))
                at = [next(place) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)).cast(pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([None if i is None else _signed(keys[i]).tolist() for i in at], pa.list_(pa.int64())),
                        pa.array([None if i is None else short[i].tobytes() for i in at], pa.binary()),
                    ],
                    names=["doc_id", "class", "n", "keys", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, class binary, n bigint, keys array<bigint>, sketch binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over edges (a, b), by neighbour minima and pointer jumps."""
    both = settle(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    files = max(1, min(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // FILE_ROWS)))
    put = lambda x: settle(x.coalesce(files), "labels")
    labels = put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    total = lambda x: x.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while before is not None:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = put(labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("label")))
        up = step.select(F.col("node").alias("parent"), F.col("label").alias("top"))
        jumped = put(step.join(up, step.label == up.parent).select("node", F.col("top").alias("label")))
        after = total(jumped)
        discard(labels)
        discard(step)
        labels = jumped
        if after == before:
            break
        before = after
    discard(both)
    return labels


def _expanded(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, set (sorted hashes, 64 bits each) of the documents in ids."""

    def expand(batches):
        for batch in batches:
            for first, texts in byte_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([shingle_set(t, k).tobytes() for t in texts], pa.binary())], names=["doc_id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return settle(texts.mapInArrow(expand, "doc_id bigint, set binary"), "sets")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int, t: int) -> DataFrame:
    """The pairs whose sizes and sketches allow the threshold."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
    least = t * percent / 100 - 6 * math.sqrt(t * percent / 100 * (1 - percent / 100))

    def alike(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return wide.select("a", "b", "sa", "sb").mapInArrow(alike, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that hold on the full sets."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"s{x}"))

    def hold(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return settle(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(hold, "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; linked means a Jaccard similarity of percent / 100 or more."""
    rows, bands = bands_for(percent / 100)
    signs = settle(signatures(docs, shingle, rows, bands), "signatures")
    classes = settle(signs.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    # one row for each representative: a doc_id that came more than once has the same set in every such row, or else several
    reps = settle(signs.join(classes, (signs["class"] == classes["class"]) & (signs.doc_id == classes.rep)).select(signs.doc_id, "n", "keys", "sketch").distinct(), "representatives")
    members = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    heads = settle(members.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "head"), "heads")
    shared = settle(members.join(heads, "key").select("key", "head", "doc_id", "n"), "buckets")
    pairs = settle(_likely(shared.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), reps, percent, rows * bands), "pairs")
    sets = _expanded(docs, shared.select("doc_id").distinct(), shingle)
    links = _confirmed(pairs, sets, percent)
    labels = components(links)
    more = _across(shared, labels, sets, percent)
    if more is not None:
        labels = components(links.union(more))
    found = settle(classes.join(labels, classes.rep == labels.node, "left").select("class", F.coalesce("label", "rep").alias("component_id")), "components")
    for done in (shared, sets, heads, reps, pairs):
        discard(done)
    out = signs.select("doc_id", "class", "n").join(found, "class", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between components that share a bucket; None if no bucket holds several."""
    named = settle(shared.join(labels, shared.doc_id == labels.node, "left").select("key", "doc_id", "n", F.coalesce("label", "doc_id").alias("label")), "buckets")
    several = settle(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "lo"), "keys")
    left = settle(named.join(several, "key"), "buckets")
    discard(named)
    if left.isEmpty():
        return None
    clusters = components(left.where("lo <> label").select(F.col("lo").alias("a"), F.col("label").alias("b")).distinct())
    clustered = left.join(clusters, left.label == clusters.node).select("key", "doc_id", "n", left.label, clusters.label.alias("cluster"))
    once = settle(clustered.groupBy("cluster", "label", "doc_id", "n").agg(F.collect_list("key").alias("keys")), "clusters")
    weights = once.groupBy("cluster").agg(F.sum("n").alias("weight"))
    huge = settle(weights.where(F.col("weight") > HUGE_CLUSTER).select("cluster"), "huge")
    plain = once.join(huge, "cluster", "left_anti").select(F.struct(F.col("cluster").alias("id"), F.lit(0).alias("bucket")).alias("group"), "doc_id", "n", "label")
    by_key = once.join(huge, "cluster", "left_semi").select(F.explode("keys").alias("key"), "doc_id", "n", "label").select(F.struct(F.col("key").alias("id"), F.lit(1).alias("bucket")).alias("group"), "doc_id", "n", "label")
    rows = settle(plain.union(by_key), "groups")
    parts = rows.groupBy("group", "label").agg(F.sum("n").alias("w"))
    main = settle(parts.groupBy("group").agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("weight")).select("group", F.col("top.label").alias("main"), "weight"), "main")
    # sets that can link differ by less than one class
    size = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else F.col("n").cast("int")
    sized = rows.join(main.select("group", "main"), "group").withColumn("size", size)
    near = sized.where("label <> main").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    weigh = lambda x, w: x.groupBy("group", "size").agg(F.sum("n").alias(w))
    block = F.least(F.greatest(F.lit(LEAST_BLOCK), F.col("weight") / PIECES), F.lit(MOST_BLOCK))
    cut = weigh(near, "few_w").join(weigh(sized, "all_w"), ["group", "size"]).join(main.select("group", "weight"), "group")
    cut = settle(cut.select("group", "size", F.ceil(F.col("few_w") / block).alias("na"), F.ceil(F.col("all_w") / block).alias("nb")), "cuts")
    dealt = lambda x: x.join(cut, ["group", "size"]).join(sets, "doc_id")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fields = ["doc_id", "label", "main", "set"]
    few = dealt(near).select("group", "size", own("na").alias("i"), every("nb").alias("j"), F.lit(True).alias("few"), *fields)
    all_ = dealt(sized).select("group", "size", every("na").alias("i"), own("nb").alias("j"), F.lit(False).alias("few"), *fields)

    def meet(table: pa.Table) -> pa.Table:
        few = table.column("few").to_numpy(zero_copy_only=False)
        ids, label, main = (table.column(c).to_numpy() for c in ("doc_id", "label", "main"))
        held = [np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()]
        mine, theirs = np.flatnonzero(few), np.flatnonzero(~few)
        out: list[tuple[int, int]] = []
        if len(mine) and len(theirs):
            size = np.array([len(held[i]) for i in theirs])
            flat, owner = np.concatenate([held[i] for i in theirs]), np.repeat(np.arange(len(theirs)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for x in mine.tolist():
                lo, hi = np.searchsorted(flat, held[x], "left"), np.searchsorted(flat, held[x], "right")
                runs = hi - lo
                at = np.repeat(lo - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
                both = np.bincount(owner[at], minlength=len(theirs))
                linked = (100 * both >= percent * (size + len(held[x]) - both)) & (label[theirs] != label[x])
                out += [(int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))) for y in theirs[linked].tolist()]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    found = settle(few.unionByName(all_).groupBy("group", "size", "i", "j").applyInArrow(meet, "a bigint, b bigint"), "links")
    for done in (left, once, rows, main, cut, several, huge):
        discard(done)
    return found


def deduplicate(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates of a smaller doc_id; of rows that share doc_id and text one stays. Documents without words stay. Columns and their order stay."""
    seen = settle(near_duplicates(docs, shingle=shingle, percent=percent).select("doc_id", "kept"), "kept")
    ids = seen.where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = settle(ids.where("not kept or n > 1"), "marked")
    single = docs.join(marked.select("doc_id"), "doc_id", "left_anti").select(*columns(docs.columns))
    if marked.where("n > 1").isEmpty():
        return single
    repeated = docs.join(marked.where("kept").select("doc_id"), "doc_id", "left_semi").select(*columns(docs.columns))
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def op6_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), shingle=3, percent=85)


def brute_force(docs: list[tuple[int, str | None]], k: int = 3, percent: int = 85) -> list[tuple[int, int, int, bool]]:
    """The contract over all pairs, for tests."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return [(d, len(sets[i]), low[root(i)], low[root(i)] == d) for i, (d, _) in enumerate(docs)]


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), edge AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), link AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
