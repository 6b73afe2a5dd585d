"""Exact top-k inner products by a dual-tree search over cover trees.

Method. A node has a centre, a covering radius and members; a cover tree's children stand apart by more than half the
node's scale and hold what lies within it. Queries and data are both indexed so. For a query node with centre q and radius
s, and a data node with centre p and radius r, no product of their members exceeds

    q.p + s |p| + r |q| + s r

so a pair of nodes is left out when that is below the worst kth score among the query node's members. The upper nodes are
tables: every vector goes to the cell of its nearest pivot (a bounded sample gives the pivots), and a cell's vectors are
packed into blocks of up to BLOCK, the queries into groups of up to QUERY_GROUP. Each group first meets the largest block
of its own cell, which gives every query a kth score to beat. Blocks are dealt to buckets of one cell each, of about
BUCKET_BYTES; a group goes to the buckets whose ball its bound reaches, and there meets the blocks whose bounds it
reaches. A cover tree within the block and one over the group prune further; leaves are multiplied as matrices. Only what
beats a query's kth score leaves a task, and a window keeps the best k of all tasks.

The driver and the broadcasts hold the pivots and a radius a bucket. Nothing is approximate: pivots, cells and blocks decide
only what is looked at first. Where vectors have no structure (random directions), no bound prunes anything, and the
work is that of all products of queries and data, done as matrix products.

Defined results. Vectors that are null, or hold null or non-finite components, and rows with a null id take no part.
Shorter vectors count as padded with zeros. Rows that carry the query's own id aren't its candidates; repeated queries
count once. Equal scores go to the smaller id; repeated data rows are all candidates. No queries or no data: no rows.
Scores are exact wherever they fit 64 bits; where they might not, it is an error.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: Queries of a group, vectors of a block, members of a leaf, vectors that a task packs at a time, bytes of a bucket.
QUERY_GROUP, BLOCK, LEAF, HELD, BUCKET_BYTES = 1024, 4096, 256, 65_536, 64 << 20
#: Cells at most, and vectors to a cell at least.
PIVOTS, CELL = 64, 2048
#: Products of one step (8 bytes each), and queries and vectors whose state and trees a worker keeps.
STEP, KEPT_QUERIES, KEPT_VECTORS = 1 << 20, 16_384, 65_536


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)
    #: of the children, or of the node alone if it is closed: centres, norms, radii, members in a row, where each child's start, which are closed
    below: tuple[np.ndarray, ...] | None = None


def _closed_or_split(node: Node) -> Node:
    kids = node.children or [node]
    sizes = np.array([len(x.members) for x in kids])
    node.below = (np.stack([x.centre for x in kids]), np.array([x.norm for x in kids]), np.array([x.radius for x in kids]), np.concatenate([x.members for x in kids]), np.cumsum(sizes) - sizes, np.array([not x.children for x in kids]), sizes)
    return node


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node | None:
    """The tree over the rows of points; nodes of up to `leaf` members stay closed, and so do those that would fall apart into children of a few members each."""
    if not len(points):
        return None
    squares = np.einsum("ij,ij->i", points, points)

    def far(members: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[members] + squares[c] - 2 * (points[members] @ points[c]), 0))

    def node(c: int, members: np.ndarray, away: np.ndarray) -> Node:
        slack = 1e-7 * (math.sqrt(squares[c]) + 1)
        return Node(points[c], math.sqrt(squares[c]), float(away.max()) * (1 + 1e-9) + slack, members)

    every = np.arange(len(points))
    root = node(0, every, far(every, 0))
    todo, made = [(root, 0)], []
    while todo:
        top, c = todo.pop()
        made.append(top)
        away = far(top.members, c)
        widest = float(away.max())
        if len(top.members) <= leaf or widest < 1e-6:
            continue
        most = max(2, len(top.members) // max(1, leaf // 16))
        scale = 2.0 ** (math.ceil(math.log2(widest)) - 1)
        rest, centre, kids = top.members, c, []  # the node's own centre is its first child's
        while len(rest) and len(kids) <= most:
            d = far(rest, centre)
            near = d <= scale
            near |= rest == centre
            kids.append((centre, node(centre, rest[near], d[near])))
            rest = rest[~near]
            centre = int(rest[0]) if len(rest) else -1
        if len(kids) == 1 or len(rest):
            continue
        top.children = [x for _, x in kids]
        todo += [(x, i) for i, x in kids]
    for x in made:
        _closed_or_split(x)
    return root


class Search:
    """The best k of one group of queries, over any number of data trees; scores below `kth` are of no interest."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, root: Node | None = None, kth: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.none = np.iinfo(np.int64).min if queries.dtype == np.int64 else -np.inf
        self.root = root or cover_tree(queries.astype(np.float64), 1)  # down to single queries: a wide group prunes nothing
        self.best = np.full((len(ids), k), self.none, dtype=queries.dtype)
        self.who = np.zeros((len(ids), k), dtype=np.int64)
        self.kth = np.full(len(ids), self.none, dtype=queries.dtype) if kth is None else kth.copy()
        self.multiplied = 0

    def add(self, ids: np.ndarray, points: np.ndarray, tree: Node | None = None) -> None:
        if not len(ids) or not len(self.ids):
            return
        stack = [(math.inf, self.root, tree or cover_tree(points.astype(np.float64)))]
        while stack:
            bound, q, p = stack.pop()
            if bound < self.kth[q.members].min():
                continue
            bounds = self._bounds(q, p)
            *_, mine, at, closed, sizes = q.below
            theirs, shut = p.children or [p], p.below[5]
            least = np.minimum.reduceat(self.kth[mine], at)
            for j in np.argsort(-bounds.max(axis=0), kind="stable").tolist():  # the best first: what they raise a kth score to spares others
                if shut[j]:
                    need = closed & (bounds[:, j] >= np.minimum.reduceat(self.kth[mine], at))
                    if need.any():
                        self._multiply(mine[np.repeat(need, sizes)], theirs[j].members, ids, points)
            open_ = (bounds >= least[:, None]) & ~(closed[:, None] & shut[None, :])
            kids = q.children or [q]
            pairs = np.argwhere(open_)
            for i, j in pairs[np.argsort(bounds[open_], kind="stable")].tolist():  # the largest is popped first
                stack.append((bounds[i, j], kids[i], theirs[j]))

    @staticmethod
    def _bounds(q: Node, p: Node) -> np.ndarray:
        """For each child of q (or q, if closed) and each of p the largest product that their members can have."""
        (c, n, r), (d, m, s) = q.below[:3], p.below[:3]
        b = c @ d.T + r[:, None] * m + n[:, None] * s + r[:, None] * s
        return b + 1e-9 * (n + r)[:, None] * (m + s) + 1e-6

    def _multiply(self, mine: np.ndarray, theirs: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        step = max(1, STEP // len(mine))
        theirs = theirs[np.argsort(ids[theirs], kind="stable")]
        for i in range(0, len(theirs), step):
            some = theirs[i : i + step]
            self.multiplied += len(mine) * len(some)
            scores, their_ids = self.queries[mine] @ points[some].T, ids[some]
            scores[self.ids[mine][:, None] == their_ids[None, :]] = self.none
            floor = self.kth[mine]
            if len(some) > self.k and (floor == self.none).any():  # the first scores of these queries
                floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
            tie = (scores == floor[:, None]) & (scores > self.none)
            if np.count_nonzero(tie) > 4 * self.k * len(mine):  # copies of one vector: only the smallest ids can count
                tie &= np.cumsum(tie, axis=1) <= self.k
            row, column = np.nonzero((scores > floor[:, None]) | tie)
            if len(row):
                self._merge(mine[row], scores[row, column], their_ids[column])

    def _merge(self, q: np.ndarray, s: np.ndarray, w: np.ndarray) -> None:
        met = np.unique(q)
        q, s, w = np.concatenate((q, np.repeat(met, self.k))), np.concatenate((s, self.best[met].ravel())), np.concatenate((w, self.who[met].ravel()))
        held = s > self.none
        q, s, w = q[held], s[held], w[held]
        order = np.lexsort((w, -s, q))
        q, s, w = q[order], s[order], w[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        top = place < self.k
        self.best[q[top], place[top]], self.who[q[top], place[top]] = s[top], w[top]
        self.kth[met] = np.maximum(self.kth[met], self.best[met, -1])

    def found(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.best > self.none)
        columns = self.ids[q], self.who[q, place], self.best[q, place].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _vectors(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of vectors, padded with zeros to one width."""
    column = batch.column("v")
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((batch.num_rows, width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(zero_copy_only=False), out


_PACKED = "cell int, number bigint, n int, centre array<double>, radius double, reach double, ids binary, vectors binary"


def _cells(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each point and its distance."""
    square = np.maximum((points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T, 0)
    cell = square.argmin(axis=1)
    return cell, np.sqrt(square[np.arange(len(points)), cell]) * (1 + 1e-9) + 1e-6 * (1 + np.abs(pivots).max())


def _packed(rows: DataFrame, pivots: np.ndarray, most: int, kind: str) -> DataFrame:
    """Blocks of up to `most` vectors of one cell: a ball around them and, as binary, ids and components."""

    def pack(batches):
        held, n, made, task = [], 0, 0, TaskContext.get().partitionId()

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, points = np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
            cell, away = _cells(points.astype(np.float64), pivots)
            order = np.argsort(cell, kind="stable")
            for c, first, size in zip(*np.unique(cell[order], return_index=True, return_counts=True), strict=True):
                for i in range(first, first + size, most):
                    some = order[i : min(i + most, first + size)]
                    part = points[some].astype(np.float64)
                    centre = part.mean(axis=0)
                    radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9) + 1e-6
                    line = {"cell": int(c), "number": task << 32 | made, "n": len(some), "centre": centre.tolist(), "radius": radius, "reach": float(away[some].max()), "ids": ids[some].astype("<i8").tobytes(), "vectors": points[some].astype(kind).tobytes()}
                    made += 1
                    yield pa.RecordBatch.from_pylist([line], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                held.append(_vectors(batch.slice(at, HELD), pivots.shape[1]))
                n += len(held[-1][0])
                if n >= HELD:
                    yield from blocks()
                    held, n = [], 0
        if held:
            yield from blocks()

    schema = pa.schema([("cell", pa.int32()), ("number", pa.int64()), ("n", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("reach", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])
    return rows.select("id", "v").mapInArrow(pack, _PACKED)


def _searched(pairs: DataFrame, k: int, width: int, kind: str, big: bool, kth_only: bool) -> DataFrame:
    """pairs: a group (group, g_ids, g_vectors, kth) and a block (number, ids, vectors) a row. The scores that may be among a query's best, or the kth ones of a group."""
    number = np.int64 if big else np.float64

    def matrix(raw: pa.Scalar) -> np.ndarray:
        return np.frombuffer(raw.as_buffer(), dtype=kind).reshape(-1, width).astype(number)

    def search(batches):
        groups: OrderedDict[int, Search] = OrderedDict()
        blocks: OrderedDict[int, tuple[np.ndarray, np.ndarray, Node]] = OrderedDict()

        def out(group: int, s: Search) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([s.kth.tobytes()], pa.binary())], names=["group", "kth"]) if kth_only else s.found()

        for batch in batches:
            g, b = batch.column("group").to_pylist(), batch.column("number").to_pylist()
            for i in range(batch.num_rows):
                if g[i] not in groups:
                    kth = batch.column("kth")[i]
                    groups[g[i]] = Search(np.frombuffer(batch.column("g_ids")[i].as_buffer(), dtype="<i8"), matrix(batch.column("g_vectors")[i]), k, kth=np.frombuffer(kth.as_buffer(), dtype=number) if kth.is_valid else None)
                groups.move_to_end(g[i])
                if b[i] is not None:
                    if b[i] not in blocks:
                        points = matrix(batch.column("vectors")[i])
                        blocks[b[i]] = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype="<i8"), points, cover_tree(points.astype(np.float64))
                    blocks.move_to_end(b[i])
                    groups[g[i]].add(*blocks[b[i]])
                while len(groups) > 1 and sum(len(s.ids) for s in groups.values()) > KEPT_QUERIES:
                    yield out(*groups.popitem(last=False))
                while len(blocks) > 1 and sum(len(x[0]) for x in blocks.values()) > KEPT_VECTORS:
                    blocks.popitem(last=False)
        for item in groups.items():
            yield out(*item)

    columns = pairs.select("group", "g_ids", "g_vectors", "kth", "number", "ids", "vectors")
    return columns.mapInArrow(search, "group bigint, kth binary" if kth_only else "query_id bigint, vec_id bigint, score bigint")


def top_inner_products(data: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of data with the largest products. Both have id (bigint) and v (array<bigint>)."""
    spark, whole = data.sparkSession, lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0))).first()
    wanted = queries.select("id", "v").distinct()
    (n, wide, largest), (nq, wide_q, largest_q) = whole(data), whole(wanted)
    width, bound = max(wide, wide_q, 1), max(wide, wide_q, 1) * int(largest) * int(largest_q)
    if not n or not nq:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if bound >= 1 << 63:
        raise ValueError("inner products may not fit 64 bits")
    big, kind = bound >= 1 << 53, "<i4" if max(largest, largest_q) < 1 << 31 else "<i8"
    number = "<i8" if big else "<f8"
    first = data.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, n // CELL))).collect()
    pivots = np.zeros((len(first), width))
    for i, r in enumerate(first):
        pivots[i, : len(r["v"])] = r["v"]

    blocks = settle(_packed(data, pivots, BLOCK, kind), "blocks")
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-nq // (len(pivots) * QUERY_GROUP)))))

    def celled(batches):
        for batch in batches:
            cell, _ = _cells(_vectors(batch, width)[1].astype(np.float64), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["id", "v", "cell"])

    dealt = wanted.mapInArrow(celled, "id bigint, v array<bigint>, cell int").repartition("cell", salt)
    groups = settle(_packed(dealt, pivots, QUERY_GROUP, kind), "groups").select("cell", F.col("number").alias("group"), F.col("centre").alias("g_centre"), F.col("radius").alias("g_radius"), F.col("ids").alias("g_ids"), F.col("vectors").alias("g_vectors"))

    # the largest block of a group's own cell gives every query a score to beat
    own = blocks.groupBy("cell").agg(F.max(F.struct("n", "number")).alias("m")).select(F.col("m.number").alias("number"))
    nearest = blocks.join(F.broadcast(own), "number").select("cell", "number", "ids", "vectors")  # a row a cell
    seeds = settle(_searched(groups.withColumn("kth", F.lit(None).cast("binary")).join(nearest, "cell", "left"), k, width, kind, big, True), "seeds")

    per_cell = -(-max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * width * int(kind[2]) // BUCKET_BYTES) // len(pivots))
    bucket = (F.col("cell") * per_cell + F.pmod(F.xxhash64("number"), F.lit(per_cell))).cast("int")
    stored = blocks.select(bucket.alias("bucket"), "number", "centre", "radius", "reach", "ids", "vectors")
    balls = np.array(sorted((r["bucket"], r["far"]) for r in stored.groupBy("bucket").agg(F.max("reach").alias("far")).collect()))
    norms = np.linalg.norm(pivots, axis=1)

    def reached(batches):
        at, far = (balls[:, 0] // per_cell).astype(int), balls[:, 1]
        for batch in batches:
            out, floors = [], []
            for centre, radius, kth in zip(batch.column("g_centre"), batch.column("g_radius").to_pylist(), batch.column("kth"), strict=True):
                q = np.array(centre.as_py())
                least = np.frombuffer(kth.as_buffer(), dtype=number).min()
                norm = np.linalg.norm(q)
                bounds = pivots[at] @ q + radius * norms[at] + norm * far + radius * far + 1e-9 * (norm + radius) * (norms[at] + far) + 1e-6
                out.append(balls[bounds >= least, 0].astype(int).tolist())
                floors.append(float(least) if big or np.isfinite(least) else -1e300)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64()), pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "floor", "buckets"])

    seeded = groups.drop("cell").join(seeds, "group")
    sent = seeded.mapInArrow(reached, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeded.schema.fields) + ", floor double, buckets array<int>")
    sent = sent.withColumn("bucket", F.explode("buckets")).drop("buckets")
    norm = lambda c: f"sqrt(aggregate({c}, 0D, (a, x) -> a + x * x))"
    reach = f"""aggregate(zip_with(g_centre, centre, (x, y) -> x * y), 0D, (a, x) -> a + x) + g_radius * {norm("centre")} + {norm("g_centre")} * radius + g_radius * radius
      + 1e-9D * ({norm("g_centre")} + g_radius) * ({norm("centre")} + radius) + 1e-6D >= floor"""
    found = _searched(sent.join(stored, "bucket").where(reach), k, width, kind, big, False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """id and v: the components as floor(scale * x); rows that hold something else than finite numbers are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    ok = embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return ok.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.floor(scale * e.cast("double"))).alias("v"))


def op2_exact_top_k(embeddings: DataFrame) -> DataFrame:
    v = whole_vectors(embeddings.select("vec_id", "embedding"))
    return top_inner_products(v, v.where("id % 100 = 0"), 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
