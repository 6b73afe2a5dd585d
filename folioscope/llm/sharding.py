"""Sharding by histogram sort: near-equal bytes in key order, one exchange.

Method. A document's sort key is (60 bits of its text's MD5, doc_id), so equal texts stand side by side. A slim table of
keys and sizes is written once. Rounds then count the exact bytes below candidate boundaries across all partitions: the
first round probes key prefixes, each later round splits only the prefixes that still hold a wanted splitter into 2^8,
until every splitter's byte count is within its tolerance. A splitter can fall inside a group of equal texts when the
group itself is too large; the same rounds then continue on doc_id, and inside a group of repeated rows (equal text and
doc_id) on a row number, for which the rows are written once. Shards are cut further into chunks of about CHUNK_BYTES (with
a loose tolerance), so that the exchange and the sort have tasks of one size at any input; documents cross the network
once, by chunk, and a chunk's first slot is known from its exact row count. A row finds its chunk through a table over the
first bits of its key and a binary search among the boundaries behind them.

What the driver receives, and what is broadcast, grows with the chunks (one for CHUNK_BYTES of text), not with rows: a few
counts a chunk in the first round, 2^8 for each open splitter later, one row count a chunk.

Defined results. Null text: size 1 (no bytes plus 1), sorted as an empty text of its own. A null doc_id sorts first; any
64-bit doc_id is a valid key. Repeated rows fill shards evenly, in any order among themselves. An empty table gives no
rows. Fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, settle

#: Bits of the hash, least bits of the first round, bits of a later round.
KEY_BITS, FIRST_BITS, STEP_BITS = 60, 16, 8
#: How far a shard's first byte may be from its place, as a share of a shard.
TOLERANCE = 0.001
#: Bytes of text for a chunk to aim at, and least chunks to a shard.
CHUNK_BYTES, LEAST_CHUNKS = 256 << 20, 16


def key_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


class _Keys:
    """Sort keys as fields of non-negative numbers: hash, upper and lower half of doc_id (0 and 0 for null), row number."""

    def __init__(self, low: int | None, high: int | None, numbered: bool):
        self.low, span = (0, 0) if low is None else (low >> 32, (high >> 32) - (low >> 32) + 1)
        self.base = low & 0xFFFFFFFF if span == 1 else 0  # ids close together: their lower halves start at 0, too
        self.widths = [KEY_BITS, max(1, span.bit_length()), max(1, (high - low).bit_length()) if span == 1 else 32, *([63] if numbered else [])]
        self.names = ["h", "u", "l", "r"][: len(self.widths)]
        self.bits = sum(self.widths)

    def columns(self, text: Column, doc_id: Column) -> list[Column]:
        zero, d = F.lit(0).cast("long"), doc_id.cast("long")
        upper = F.coalesce(F.shiftright(d, 32) - F.lit(self.low).cast("long") + 1, zero)
        lower = F.coalesce(d.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) - F.lit(self.base).cast("long"), zero)
        return [key_hash(text).alias("h"), upper.alias("u"), lower.alias("l")]

    def prefix(self, depth: int) -> list[Column]:
        """The first bits of a key, field by field."""
        out = []
        for name, w in zip(self.names, self.widths, strict=True):
            take = min(w, depth)
            depth -= take
            out.append((F.shiftrightunsigned(name, w - take) if take else F.lit(0).cast("long")).alias(name))
        return out

    def number(self, fields: list[int], depth: int) -> int:
        out = 0
        for x, w in zip(fields, self.widths, strict=True):
            take = min(w, depth)
            depth -= take
            out = (out << take) | x
        return out

    def fields(self, prefix: int, depth: int) -> tuple[int, ...]:
        out = []
        for w in self.widths:
            take = min(w, depth)
            depth -= take
            out.append((prefix >> depth) & (1 << take) - 1)
        return tuple(out)

    def deeper(self, depth: int) -> int:
        """The next depth; a round stays within a field."""
        edge = 0
        for w in self.widths:
            edge += w
            if depth < edge:
                return min(depth + STEP_BITS, edge)
        return edge


class _Probe:
    """Finds keys with a wanted number of bytes below them, by rounds of counting."""

    def __init__(self, slim: DataFrame, keys: _Keys):
        self.slim, self.keys, self.repeats = slim, keys, False

    def count(self, depth: int, within: list[int] | None, parent: int) -> list[tuple[int, int, int]]:
        """(prefix, bytes, rows) at a depth, ascending, of the rows whose prefix at parent depth is one of within."""
        rows = self.slim
        if within is not None:  # a row for each open splitter
            names = [f"p{n}" for n in self.keys.names]
            open_ = rows.sparkSession.createDataFrame([self.keys.fields(x, parent) for x in within], ", ".join(f"{n} bigint" for n in names))
            rows = rows.withColumns(dict(zip(names, self.keys.prefix(parent), strict=True))).join(F.broadcast(open_), names, "left_semi")
        got = rows.groupBy(*self.keys.prefix(depth)).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((self.keys.number(list(r)[:-2], depth), r["bytes"], r["n"]) for r in got)

    def splitters(self, wanted: list[tuple[float, float]], depth: int) -> list[int]:
        """For each (bytes, tolerance) the key with about so many bytes below it, from a first round at depth on."""
        done: dict[int, int] = {}
        open_ = {i: (0, 0) for i in range(len(wanted))}  # splitter -> prefix that holds it, bytes below the prefix
        parent, bits = 0, self.keys.bits
        while open_:
            parts = self.count(depth, sorted({p for p, _ in open_.values()}) if parent else None, parent)
            names, sums = [x[0] for x in parts], [0]
            for x in parts:
                sums.append(sums[-1] + x[1])
            shift, after = depth - parent, {}
            for i, (p, below) in open_.items():
                goal, slack = wanted[i]
                lo, hi = bisect.bisect_left(names, p << shift), bisect.bisect_left(names, (p + 1) << shift)
                at = bisect.bisect_left(sums, goal - below + sums[lo], lo + 1, hi + 1) - 1  # the part in which the goal lies
                if at >= hi:  # all of it is below
                    done[i] = (p + 1) << (bits - parent)
                    continue
                before, until = goal - below - (sums[at] - sums[lo]), below + sums[at + 1] - sums[lo] - goal
                last = depth == bits
                if before <= slack or last and before <= until:
                    done[i] = names[at] << (bits - depth)
                elif until <= slack or last:
                    done[i] = (names[at] + 1) << (bits - depth)
                else:
                    after[i] = (names[at], goal - before)
                self.repeats |= last and parts[at][2] > 1 and min(before, until) > slack
            open_, parent, depth = after, depth, self.keys.deeper(depth)
        return [done[i] for i in range(len(wanted))]


def _with_chunk(rows: DataFrame, cuts: list[int], keys: _Keys) -> DataFrame:
    """rows and chunk, the number of cuts at or below a row's key: a table over key prefixes, and a search behind each."""
    bits = max(1, len(cuts).bit_length())
    behind: list[list[int]] = [[] for _ in range(1 << bits)]
    for c in cuts:
        behind[min(c >> (keys.bits - bits), len(behind) - 1)].append(c)
    table, seen = [], 0
    for p, mine in enumerate(behind):
        table.append((p, seen, [keys.fields(c, keys.bits) if c >> keys.bits == 0 else (1 << KEY_BITS, *[0] * (len(keys.names) - 1)) for c in sorted(mine)]))
        seen += len(mine)
    fields = ", ".join(f"{n}: bigint" for n in keys.names)
    places = rows.sparkSession.createDataFrame(table, f"_prefix bigint, _before int, _cuts array<struct<{fields}>>")
    middle = "CAST((s.lo + s.hi) div 2 AS INT)"
    key = f"named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in keys.names)})"
    search = f"""aggregate(sequence(1, CAST(ceil(log2(size(_cuts) + 1)) AS INT) + 1), named_struct('lo', 0, 'hi', size(_cuts)), (s, x) -> CASE WHEN s.lo >= s.hi THEN s
      WHEN get(_cuts, {middle}) <= {key} THEN named_struct('lo', {middle} + 1, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', {middle}) END, s -> s.lo)"""
    placed = rows.withColumn("_prefix", F.shiftrightunsigned("h", KEY_BITS - bits)).join(F.broadcast(places), "_prefix")
    return placed.withColumn("chunk", F.col("_before") + F.expr(search)).drop("_prefix", "_before", "_cuts")


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size (bytes of text plus 1), shard (0 to shards - 1) and slot (from 0 in each shard); rows come chunk by chunk in key order."""
    keep = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    text, doc_id = F.col("row.text"), F.col("row.doc_id")
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    numbered = False
    while True:
        keys = _Keys(low, high, numbered)
        number = [F.col("r")] if numbered else []
        slim = settle(rows.select(*keys.columns(text, doc_id), *number, size_of(text).alias("size")), "shard-keys")
        total = slim.agg(F.sum("size")).first()[0]
        if total is None:
            schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
            return docs.sparkSession.createDataFrame([], schema)
        each = max(LEAST_CHUNKS, -(-total // (shards * CHUNK_BYTES)))
        share = total / (shards * each)
        wanted = [(i * share, tolerance * total / shards if i % each == 0 else share / 4) for i in range(1, shards * each)]
        probe = _Probe(slim, keys)
        cuts = probe.splitters(wanted, min(KEY_BITS, max(FIRST_BITS, (4 * len(wanted)).bit_length())))
        if numbered or not probe.repeats:
            break
        discard(slim)
        rows, numbered = settle(rows.withColumn("r", F.monotonically_increasing_id()), "numbered"), True  # numbers hold only once written
    exact = [0, *cuts[each - 1 :: each], 1 << keys.bits]
    cuts = sorted(min(max(c, exact[i // each]), exact[i // each + 1]) if i % each else c for i, c in enumerate(cuts, 1))  # a loose cut passes no exact one
    n = {r["chunk"]: r["count"] for r in _with_chunk(slim, cuts, keys).groupBy("chunk").count().collect()}
    discard(slim)
    firsts, seen = [], 0
    for c in range(shards * each):
        seen = 0 if c % each == 0 else seen
        firsts.append((c, c // each, seen))
        seen += n.get(c, 0)
    starts = F.broadcast(docs.sparkSession.createDataFrame(firsts, "chunk int, shard int, first bigint"))
    placed = _with_chunk(rows.select("row", *keys.columns(text, doc_id), *number), cuts, keys)
    ranked = placed.withColumn("place", F.row_number().over(Window.partitionBy("chunk").orderBy(*keys.names))).join(starts, "chunk")
    return ranked.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], size_of(text).alias("size"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"))


def op9_sharding(docs: DataFrame, shards: int = 8) -> DataFrame:
    placed = shard_documents(docs.select("doc_id", "text"), shards)
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
