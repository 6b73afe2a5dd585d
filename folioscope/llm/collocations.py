"""Phrase collocations: frequent word sequences and how much more often they occur than chance, counted in suffix subtrees.

Method, after ERA (elastic range suffix trees). Words and then pairs of neighbouring words are counted; what is rare can't
stand in a frequent phrase and ends a suffix. Vertical partitioning then groups the prefixes of all suffixes: a prefix is one
word, or two where more suffixes start with the word than the memory budget allows; prefixes fall in bins by their hash, and
neighbouring bins are joined to groups of up to a budget of suffixes. Each suffix, cut to DEPTH words and counted once a chunk
where it repeats, goes to its prefix's group. A group builds its subtree on its own: the suffixes in order, where runs that
share their first d words are the nodes of depth d and a node's count is the sum of its leaves. Suffixes of a pair that
exceeds the budget by itself are dealt over groups by all their words; such groups give partial counts that are added up.

A bitmap of fixed size says in a task which words, and then which pairs, may be frequent: hashes that collide let too much
through, never too little. Counts come from the words themselves. The driver receives the bitmaps, the load of each bin and
the prefixes over the budget, of which there are at most as many as groups.

Defined results. A-Z become a-z; pieces end at any of . , ; : ! ? and line ends; words are what stands between blanks and
tabs. Null text is empty, null lang is `und`. Documents and pieces don't run into each other. Repeated rows count each. An
empty table gives no rows. Other columns, doc_id included, aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_chunks, settle

#: Words of a phrase at most: the depth of the subtrees.
DEPTH = 5
#: A phrase occurs so often at least.
LEAST = 100
#: Phrases reported of a lang.
TOP = 2000
#: Suffixes in a group at most: what one task holds, some 100 bytes each.
BUDGET = 1 << 20
#: Text bytes within which a task counts repeated suffixes once.
CHUNK = 3 << 20
#: Bits of the bitmaps of words and pairs that may be frequent (16 MB each).
BITMAP_BITS = 27
#: Bits of the bins that prefixes fall in, at most.
BIN_BITS = 22

_LOW = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_FACTOR = 40503


class Words:
    """The words of some texts of one lang: `codes` number them within `dictionary`; `linked` says that the next word stands in the same piece."""

    def __init__(self, lang: str, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts).translate(_LOW), dtype=np.uint8)
        kind = _CLASS[raw]
        inside = np.concatenate(([False], kind == 0, [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0].tobytes())).dictionary_encode()
        self.lang, self.dictionary, self.codes = lang, words.dictionary, words.indices.to_numpy().astype(np.int64)
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.linked = np.zeros(len(starts), dtype=bool)
        self.linked[:-1] = piece[1:] == piece[:-1]

    def hashes(self) -> np.ndarray:
        """32 bits for each word of the dictionary."""
        return word_hashes(self.lang, self.dictionary.to_pylist())

    def hashed(self, frequent: np.ndarray) -> np.ndarray:
        """The hash of the word at each place; links to and from words that aren't frequent are cut."""
        h = self.hashes()
        at = h[self.codes]
        often = _in_bitmap(frequent, h)[self.codes]
        self.linked &= often
        self.linked[:-1] &= often[1:]
        return at


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) >> 32 for w in words), dtype=np.int64, count=len(words))


def _in_bitmap(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at & ((1 << BITMAP_BITS) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _bitmap(places: DataFrame) -> np.ndarray:
    """The bitmap of the column `place`: at most 2^BITMAP_BITS bits reach the driver."""
    at = places.select(((F.col("place").bitwiseAND((1 << BITMAP_BITS) - 1)) + 1).alias("at"))  # buckets count from 1
    out = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for r in at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        first = (r["b"] - 1) * len(part)
        out[first : first + len(part)] |= part[: len(out) - first]
    return out


def _chunks(batches):
    """Words of the texts of one lang and chunk."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            mine = batch.column("text").filter(pc.equal(langs.indices, k))
            for _, texts in byte_chunks(mine, CHUNK):
                yield Words(lang, texts)
                pa.default_memory_pool().release_unused()


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n of every word."""

    def count(batches):
        for w in _chunks(batches):
            n = np.bincount(w.codes, minlength=len(w.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array([w.lang] * len(n), pa.string()), w.dictionary, pa.array(n, pa.int64())], names=["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, bitmap: Broadcast) -> DataFrame:
    """pair (the hashes of two neighbouring words), n: occurrences at least."""

    def count(batches):
        for w in _chunks(batches):
            h = w.hashed(bitmap.value)
            at = np.flatnonzero(w.linked)
            pairs, n = np.unique(h[at] << 32 | h[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return texts.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class Groups:
    """Vertical partitioning: which group a suffix goes to by its first two words."""

    def __init__(self, pairs: DataFrame, budget: int):
        first, both = F.shiftrightunsigned("pair", 32), F.shiftrightunsigned("pair", 32) * _FACTOR + F.col("pair").bitwiseAND((1 << 32) - 1)
        total = pairs.agg(F.sum("n")).first()[0] or 0
        self.budget = max(1, min(budget, total // int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        self.bits = min(BIN_BITS, max(12, (total // self.budget).bit_length() + 4))
        longer = pairs.groupBy(first.alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") > self.budget).select("word")
        self.long_words = np.sort(np.array([r["word"] for r in longer.collect()], dtype=np.int64))
        over = [(r["pair"], r["n"]) for r in pairs.where(F.col("n") > self.budget).collect()]
        self.over = np.sort(np.array([p for p, _ in over], dtype=np.int64))
        extended = pairs.join(longer.withColumn("extended", F.lit(True)), first == F.col("word"), "left")
        prefix = F.when(F.col("extended"), both).otherwise(first)
        bins = extended.where(F.col("n") <= self.budget).groupBy(F.shiftright(prefix, 8).bitwiseAND((1 << self.bits) - 1).alias("bin")).agg(F.sum("n").alias("n"))
        load = np.zeros(1 << self.bits, dtype=np.int64)
        for r in bins.collect():
            load[r["bin"]] = r["n"]
        self.of_bin, self.count = self._joined(load)
        self.spread = max(1, -(-sum(n for _, n in over) // self.budget))

    def _joined(self, load: np.ndarray) -> tuple[np.ndarray, int]:
        """Neighbouring bins as groups of at most the budget, but for bins that exceed it alone."""
        out, group, held = np.empty(len(load), dtype=np.int32), 0, 0
        for k, n in enumerate(load.tolist()):
            if held and held + n > self.budget:
                group, held = group + 1, 0
            out[k] = group
            held += n
        return out, group + 1

    def __call__(self, first: np.ndarray, second: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, whether it has partial counts) of suffixes with these hashes of the first word, the second and all words."""
        prefix = np.where(np.isin(first, self.long_words), first * _FACTOR + second, first)
        group = self.of_bin[(prefix >> 8) & ((1 << self.bits) - 1)]
        partial = np.isin(first << 32 | second, self.over)
        return np.where(partial, self.count + whole % self.spread, group), partial


#: A row holds the suffixes of one lang and chunk that go to one group, as lists of equal length.
SUFFIX = "grp int, lang string, suffixes array<string>, partial array<boolean>, n array<bigint>"


def suffixes(texts: DataFrame, bitmap: Broadcast, pairs: np.ndarray, groups: Groups) -> DataFrame:
    """The suffixes of 2 to DEPTH words whose pairs may all be frequent, with their group and how often a chunk has them."""
    shared = texts.sparkSession.sparkContext.broadcast((pairs, groups))

    def cut(batches):
        words, (likely, grouping) = bitmap.value, shared.value
        for w in _chunks(batches):
            h = w.hashed(words)
            at = np.flatnonzero(w.linked)
            w.linked[at] = _in_bitmap(likely, h[at] * _FACTOR + h[at + 1])
            starts = np.flatnonzero(w.linked)
            if not len(starts):
                continue
            linked, codes = np.concatenate((w.linked, np.zeros(DEPTH, dtype=bool))), np.concatenate((w.codes, np.zeros(DEPTH, dtype=np.int64)))
            ids, going, size = codes[starts], np.ones(len(starts), dtype=bool), np.ones(len(starts), dtype=np.int64)
            for k in range(1, DEPTH):
                going = going & linked[starts + k - 1]
                size += going
                following = np.where(going, codes[starts + k] + 1, 0)
                _, first, ids = np.unique(ids * (len(w.dictionary) + 1) + following, return_index=True, return_inverse=True)
            n, at, size = np.bincount(ids), starts[first], size[first]
            columns = [w.dictionary.take(pa.array(codes[at + k], pa.int64(), mask=size <= k)) for k in range(DEPTH)]
            whole = np.zeros(len(at), dtype=np.int64)
            for k in range(DEPTH):
                whole = (whole * _FACTOR + np.where(size > k, h[np.minimum(at + k, len(h) - 1)], 0)) & ((1 << 40) - 1)
            group, partial = grouping(h[at], h[at + 1], whole)
            text = pc.binary_join_element_wise(*columns, " ", null_handling="skip")
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            listed = lambda values: pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), values)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[order][first], pa.int32()), pa.array([w.lang] * len(first), pa.string()), listed(text.take(pa.array(order))), listed(pa.array(partial[order])), listed(pa.array(n[order], pa.int64()))],
                names=["grp", "lang", "suffixes", "partial", "n"],
            )

    return texts.mapInArrow(cut, SUFFIX)


def subtree(table: pa.Table, least: int) -> pa.Table:
    """The nodes of depth 2 to DEPTH over a group's suffixes: lang, phrase, size, a. Partial ones of any count, others from `least` on."""
    table = table.combine_chunks()
    of_row = np.repeat(np.arange(len(table)), pc.list_value_length(table["n"]).to_numpy())
    langs = table["lang"].take(pa.array(of_row)).combine_chunks().dictionary_encode()
    lists = pc.split_pattern(pc.list_flatten(table["suffixes"]).combine_chunks(), " ")
    words = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy())
    m = np.full((len(sizes), DEPTH), -1, dtype=np.int32)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    m[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = words.indices.to_numpy()
    lang = langs.indices.to_numpy()
    order = np.lexsort((*[m[:, k] for k in reversed(range(DEPTH))], lang))
    m, lang, n = m[order], lang[order], pc.list_flatten(table["n"]).to_numpy()[order]
    partial = pc.list_flatten(table["partial"]).to_numpy()[order]
    new = np.concatenate(([True], lang[1:] != lang[:-1]))
    out = []
    for depth in range(1, DEPTH + 1):
        new[1:] |= m[1:, depth - 1] != m[:-1, depth - 1]
        if depth == 1:
            continue
        first = np.flatnonzero(new)  # of each run that shares its first `depth` words
        a = np.add.reduceat(n, first)
        kept = (m[first, depth - 1] >= 0) & ((a >= least) | partial[first])
        first, a = first[kept], a[kept]
        phrase = pc.binary_join_element_wise(*[words.dictionary.take(pa.array(m[first, k])) for k in range(depth)], " ")
        out.append(pa.table({"lang": langs.dictionary.take(pa.array(lang[first])), "phrase": phrase, "size": pa.array([depth] * len(a), pa.int32()), "a": pa.array(a, pa.int64())}))
    return pa.concat_tables(out)


def frequent_phrases(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n of all words; lang, phrase, size, a of the phrases of 2 to DEPTH words that occur `least` times)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = settle(word_counts(texts), "words")

    def place(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(word_hashes(lang, batch.column("word").filter(pc.equal(langs.indices, k)).to_pylist()))], names=["place"])

    frequent = docs.sparkSession.sparkContext.broadcast(_bitmap(words.where(F.col("n") >= least).mapInArrow(place, "place bigint")))
    pairs = settle(pair_counts(texts, frequent).where(F.col("n") >= least), "pairs")
    likely = _bitmap(pairs.select((F.shiftrightunsigned("pair", 32) * _FACTOR + F.col("pair").bitwiseAND((1 << 32) - 1)).alias("place")))
    nodes = suffixes(texts, frequent, likely, Groups(pairs, budget)).groupBy("grp").applyInArrow(lambda t: subtree(t, least), "lang string, phrase string, size int, a bigint")
    return words, settle(nodes.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases."""
    words, phrases = frequent_phrases(docs, least, budget)
    parts = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))

    inner = "explode(array(array_join(slice(ws, 1, size - 1), ' '), array_join(slice(ws, 2, size - 1), ' ')))"
    longer = phrases.where("size > 2").select("lang", F.col("a").alias("f"), F.expr("split(phrase, ' ')").alias("ws"), "size").select("lang", "f", F.expr(inner).alias("phrase"))
    # one word more is enough: what a longer phrase counts, the phrases between the two count at least
    taken = longer.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = phrases.join(taken, ["lang", "phrase"], "left").where("within IS NULL OR within < a").select("lang", "phrase", "size", "a")

    cuts = kept.select("lang", "phrase", "size", "a", F.expr("split(phrase, ' ')").alias("ws"), F.expr("explode(sequence(1, size - 1))").alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(ws, 1, k), ' ')").alias("head"), F.expr("array_join(slice(ws, k + 1, size), ' ')").alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    exact = "cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    scored = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", F.expr(exact).alias("score"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    each = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = each.withColumn("place", F.row_number().over(Window.partitionBy("lang", F.expr("pmod(hash(phrase), 64)")).orderBy(*best))).where(F.col("place") <= top)  # so that a lang is no single task
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def brute_force(docs: list[tuple], least: int = LEAST, top: int = TOP) -> list[tuple]:
    """From every phrase of every (lang, text), for tests."""
    import re
    from collections import Counter

    counts: dict[str, Counter] = {}
    for lang, text in docs:
        c = counts.setdefault(lang if lang is not None else "und", Counter())
        lowered = (text or "").encode().translate(_LOW).decode()
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(x for p, x in c.items() if len(p) == 1)
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside: Counter = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in often.items():
            if inside[p] < a:
                score, k = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0
), counted AS (
    SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS phrase, count(*) AS f
    FROM places, unnest([1, 2, 3, 4, 5]) AS t(s) WHERE i + s - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100 OR s = 1
), totals AS (
    SELECT lang, sum(f)::HUGEINT AS n FROM counted WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, f::HUGEINT AS a FROM counted WHERE size > 1
), kept AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.size > c.size AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
    FROM kept, unnest([1, 2, 3, 4]) AS t(k) WHERE k < size
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, k, x.f::HUGEINT AS l, y.f::HUGEINT AS r, n, (1000 * a * n) // (x.f::HUGEINT * y.f::HUGEINT) AS score
    FROM cuts JOIN counted x ON x.lang = cuts.lang AND x.phrase = head JOIN counted y ON y.lang = cuts.lang AND y.phrase = tail JOIN totals ON totals.lang = cuts.lang
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
