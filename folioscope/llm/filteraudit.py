"""Interaction of document filters: what each order of five filters removes, by weighted decision diagrams.

Method. Every document gets a mask of the filters that it fails. Documents are counted by part and mask (at most 32 rows a
part, whatever the corpus), with the good and the toxic ones apart. From these rows a decision diagram is built for each
part: a level a filter, nodes shared where their functions are equal, and a weight (documents, good, toxic) at each node: what
reaches it, from below. The 120 orders are visited so that neighbours differ by two adjacent filters; between them the
diagram swaps two levels, which rebuilds the nodes of the upper one from their grandchildren and leaves all else as it stands.
In each order, the path on which every filter is passed gives the steps: a step keeps what its pass branch weighs and
removes what its fail branch weighs.

A document fails E if a smaller doc_id has the same text. Equal texts are found by SHA-256; rows of a text are
counted by part and labels, with the smallest doc_id beside, before they meet, so that a group of copies of any size is a
few rows.

Defined results. Null text is empty, null lang the empty part. Words are maximal runs without ASCII white space. A null doc_id is
smaller than none and no doc_id is smaller than it: such rows pass E. Rows of one doc_id aren't copies of each other, though
another doc_id's text may make both fail. Labels of a repeated doc_id count as good or toxic if one row says so; a null label
is 0. An empty table has no parts and no rows. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"

#: The filters that a text decides by itself, as SQL over text, n_words and n_distinct; bits 0 to 3 of the mask.
FAILS = [
    "n_words < 200",
    "100 * n_distinct < 50 * n_words",
    "100 * (length(text) - length(regexp_replace(text, '[A-Z]+', ''))) > 3 * length(text)",
    "text rlike '[#$%&*|]'",
]


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, mask of A to D, and how many rows are alike in these."""
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    sizes = words.select("doc_id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    mask = " + ".join(f"IF({condition}, {1 << k}, 0)" for k, condition in enumerate(FAILS))
    masks = sizes.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.expr(mask).alias("mask"))
    return masks.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("rows"))


def counted_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of A to E, and the documents, the good and the toxic ones."""
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic")])
    rows = text_masks(docs).join(flags, "doc_id", "left").select("doc_id", "part", "digest", "mask", "rows", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")])
    # of each text: rows of a part and labels, of which those with the smallest doc_id are the first
    known = F.col("doc_id").isNotNull()
    alike = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(
        F.sum(F.when(known, F.col("rows")).otherwise(0)).alias("known"),
        F.sum(F.when(known, 0).otherwise(F.col("rows"))).alias("unknown"),
        F.min(F.when(known, F.struct("doc_id", "rows"))).alias("first"),
    )
    from pyspark.sql import Window

    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.when(F.col("first.doc_id") == smallest, F.col("first.rows")).otherwise(0)
    split = alike.withColumn("passing", passing + F.col("unknown")).withColumn("failing", F.col("known") + F.col("unknown") - F.col("passing"))
    each = split.select("part", "quality", "toxic", F.explode(F.expr("array(struct(mask as mask, passing as n), struct(mask + 16 as mask, failing as n))")).alias("x"))
    n = F.col("x.n")
    return each.where(n > 0).groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("quality")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k at which swapping k and k + 1, one after the other, leads through all orders of n things (n! - 1 swaps)."""
    order, going = list(range(n)), [-1] * n
    while True:
        for x in range(n - 1, -1, -1):
            at = order.index(x)
            to = at + going[x]
            if 0 <= to < n and order[to] < x:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            going[y] = -going[y]
        yield min(at, to)


class Diagram:
    """A decision diagram of failure masks: nodes are numbers, equal nodes are one.

    level[node] is the place of the node's filter in the order; low and high are its pass and fail branches; weight sums what
    is below. A leaf stands for the documents of one mask. No level is left out, as a filter that decides nothing still counts.
    """

    def __init__(self, filters: str, weights: dict[int, tuple[int, ...]]):
        self.order, self.nodes, self.ids = list(filters), [], {}
        zero = (0,) * len(next(iter(weights.values()), (0,)))

        def build(k: int, mask: int) -> int:
            if k == len(filters):
                return self.leaf(weights.get(mask, zero))
            return self.node(build(k + 1, mask), build(k + 1, mask | 1 << k))

        self.root = build(0, 0)

    def leaf(self, weight: tuple[int, ...]) -> int:
        return self._same((None, None, weight), weight)

    def node(self, low: int, high: int) -> int:
        """A node's level is how far it is from the leaves, so it doesn't have to be kept."""
        return self._same((low, high, None), tuple(a + b for a, b in zip(self.weight(low), self.weight(high), strict=True)))

    def _same(self, key: tuple, weight: tuple[int, ...]) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.nodes)
            self.nodes.append((key[0], key[1], weight))
        return self.ids[key]

    def low(self, node: int) -> int:
        return self.nodes[node][0]

    def high(self, node: int) -> int:
        return self.nodes[node][1]

    def weight(self, node: int) -> tuple[int, ...]:
        return self.nodes[node][2]

    def swap(self, k: int) -> None:
        """Swaps the filters at places k and k + 1. Nodes below stay; those above get new children."""
        done: dict[int, int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if node not in done:
                low, high = self.low(node), self.high(node)
                if depth < k:
                    done[node] = self.node(rebuilt(low, depth + 1), rebuilt(high, depth + 1))
                else:
                    done[node] = self.node(self.node(self.low(low), self.low(high)), self.node(self.high(low), self.high(high)))
            return done[node]

        self.root = rebuilt(self.root, 0)
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def all_pass(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(kept, removed) weights of each step."""
        steps, node = [], self.root
        for _ in self.order:
            steps.append((self.weight(self.low(node)), self.weight(self.high(node))))
            node = self.low(node)
        return steps

    def only(self, filter_: str) -> tuple[int, ...]:
        """What fails this filter alone."""
        node = self.root
        for x in self.order:
            node = self.high(node) if x == filter_ else self.low(node)
        return self.weight(node)


COLUMNS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit_part(weights: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order and step of one part."""
    diagram, rows = Diagram(filters, weights), []
    only = {x: diagram.only(x)[0] for x in filters}
    fails = {x: sum(w[0] for mask, w in weights.items() if mask >> k & 1) for k, x in enumerate(filters)}
    shapley = dict.fromkeys(filters, 0)
    for k in [None, *swaps(len(filters))]:
        if k is not None:
            diagram.swap(k)
        for step, (x, (kept, removed)) in enumerate(zip(diagram.order, diagram.all_pass(), strict=True), 1):
            shapley[x] += removed[0]
            rows.append(("".join(diagram.order), step, kept[0], removed[0], fails[x] - removed[0], only[x], removed[1], removed[2], x))
    return [(*row[:-1], shapley[row[-1]]) for row in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Kept, removed and lost documents of every part, filter order and step."""

    def of_part(key: tuple, table: pa.Table) -> pa.Table:
        weights = {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in table.to_pylist()}
        columns = list(zip(*[(key[0].as_py(), *row) for row in audit_part(weights)], strict=True))
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return counted_masks(docs, labels).groupBy("part").applyInArrow(of_part, COLUMNS)


def op12_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


def brute_force(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """Every filter order applied to every (doc_id, text, lang), for tests; labels: (doc_id, quality, toxic)."""
    import re

    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first: dict[str, int] = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts: dict[str, list[tuple]] = {}
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        steps = []
        for order in permutations(FILTERS):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                fails = sum(r[0][x] for r in rows)
                steps.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(r[0][x] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), x))
        shapley = {x: sum(s[4] for s in steps if s[-1] == x) for x in FILTERS}
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return out


ORACLE = r"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), masked AS (
    SELECT doc_id, part,
        (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
    FROM words
), flags AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), counted AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM masked LEFT JOIN flags USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before
    FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)
), found AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & coalesce(before, 0) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counted, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""
