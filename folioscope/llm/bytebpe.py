"""Byte-level byte-pair encoding and decoding with Spark's higher-order functions.

Method. A text is cut into words by the tokenizer's pattern, and the words of all documents are counted. Of the distinct
words, those above a count that FREQUENT words reach become arrays of byte ids, each element with the rank of the pair that
it begins; aggregate() folds over the word's length, each step merging the pair of the smallest rank, the leftmost of equals,
and looking up its two new neighbours, until no pair has a rank. Ranks stand in one literal: an array of small maps, picked by
the hash of the pair, as a Spark map is searched from its start. The folded words are broadcast, FREQUENT at most with the
vocabulary's own. In Arrow batches the words of texts are numbered, each distinct one is looked up there, and words that are
rarer, or longer than FREQUENT_BYTES, are merged by a heap over the same ranks: folding every word where it stands takes some
40 microseconds a word, and looking all up in a literal one more. What is frequent decides about speed alone, never about ids.
Decoding takes the binary pieces of ids, one after the other.

The vocabulary is a file of base64 pieces and ranks, a line each. A word that is a piece itself is that piece; ids equal
those of the tiktoken library with the same pattern, which knows the letters of Unicode 16: the pattern for texts with
characters from U+0870 on adds those that an older JVM lacks.

Defined results. Null text is empty; an empty text has no ids and decodes to no bytes. The strings of special tokens are
ordinary text. Repeated rows give a row each; other columns of the table aren't looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import trim
from .common import settle

#: Distinct words that are encoded once and handed to all tasks; bounds that literal to some 30 MB.
FREQUENT = 1 << 18
#: Bytes of a frequent word at most.
FREQUENT_BYTES = 48
#: Bytes of a word that a worker remembers.
REMEMBERED_BYTES = 256
#: Chunks that a counting task holds at a time.
HELD = 300_000
#: Small maps of each literal.
BUCKETS = 1 << 16

# Letters and numbers that Unicode 14 to 16 added to those of Unicode 13.
NEW_LETTERS = """
870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 1c89-1c8a 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7cb-a7cd a7d0-a7d1 a7d3
a7d5-a7dc a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc
105c0-105f3 10780-10785 10787-107b0 107b2-107ba 10d4a-10d65 10d6f-10d85 10ec2-10ec4 10f70-10f81 11071-11072 11075
1123f-11240 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11740-11746 11ab0-11abf 11bc0-11be0 11f02 11f04-11f10
11f12-11f33 12f90-12ff0 1342f 13441-13446 13460-143fa 16100-1611d 16a70-16abe 16d40-16d6c 18cff 1aff0-1aff3 1aff5-1affb
1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e5d0-1e5ed 1e5f0
1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af
"""
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 11f50-11f59 16130-16139 16ac0-16ac9 16d70-16d79 1ccf0-1ccf9 1d2c0-1d2d3 1e4f0-1e4f9 1e5f1-1e5fa"


def _ranges(text: str) -> str:
    return "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in text.split())


def java_pattern(pattern: str, newer: bool) -> str:
    """The tokenizer's pattern in Java's syntax; newer: with the letters and numbers that a JVM may lack."""
    more = {"L": _ranges(NEW_LETTERS), "N": _ranges(NEW_NUMBERS)} if newer else {"L": "", "N": ""}
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two, three = pattern[i : i + 2], pattern[i : i + 5]
        if three in (r"\p{L}", r"\p{N}"):
            x = three + more[three[3]]
            out.append(x if depth or not newer else f"[{x}]")
            i += 5
        elif two in (r"\s", r"\S"):
            out.append(r"\p{IsWhite_Space}" if two == r"\s" else r"\P{IsWhite_Space}")
            i += 2
        else:
            depth += (pattern[i] == "[") - (pattern[i] == "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def words_of(text: Column, pattern: str) -> Column:
    """The words of a text."""
    plain, newer = (F.regexp_extract_all(text, F.lit(java_pattern(pattern, x)), F.lit(0)) for x in (False, True))
    return F.when(text.rlike(r"[\x{870}-\x{10ffff}]"), newer).otherwise(plain)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Ranks:
    """Pieces, ranks of pairs of ids, ids of bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
        self.edge = max(self.ids.values()) + 1  # stands before the first and after the last byte of a word
        self.pieces: list[bytes | None] = [None] * self.edge
        for piece, rank in self.ids.items():
            self.pieces[rank] = piece
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.cache: dict[str, np.ndarray] = {}

    def pairs(self):
        """(left id, right id, rank of the two as one piece) for every cut of every piece into two pieces."""
        for piece, rank in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    yield a, b, rank

    def as_array(self) -> pa.Array:
        if not hasattr(self, "array"):
            self.array = pa.array(self.pieces, pa.binary())
        return self.array

    def learn(self, word: str) -> np.ndarray:
        """The ids of a word, from the cache if it is there."""
        ids = self.cache.get(word)
        if ids is None:
            raw = word.encode()
            ids = np.array(self.merge(raw), dtype=np.int32)
            if len(raw) <= REMEMBERED_BYTES:
                trim(self.cache, FREQUENT)
                self.cache[word] = ids
        return ids

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by a heap over linked parts."""
        if word in self.ids:
            return [self.ids[word]]
        get, n = self.ids.get, len(word)
        end, before, alive, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, []

        def push(i: int) -> None:
            if i >= 0 and end[i] < n and (r := get(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        for i in range(n):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]], end[i] = False, stop
            if stop < n:
                before[stop] = i
            push(before[i])
            push(i)
        return [self.ids[word[i : end[i]]] for i in range(n) if alive[i]]


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _as_literal(df: DataFrame, key: str, value: str, buckets: int, name: str) -> Column:
    """A small table as one value: an array of maps, picked by the hash of the key."""
    spark = df.sparkSession
    grouped = df.groupBy(F.expr(f"pmod(hash({key}), {buckets})").alias("bucket")).agg(F.collect_list(F.struct(key, value)).alias("entries"))
    whole = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(grouped, "bucket", "left")
    whole = whole.select("bucket", F.expr(f"coalesce(entries.{key}, array())").alias("ks"), F.expr(f"coalesce(entries.{value}, array())").alias("vs"))
    return settle(whole.groupBy().agg(F.expr("transform(array_sort(collect_list(struct(bucket, ks, vs)), (x, y) -> x.bucket - y.bucket), x -> map_from_arrays(x.ks, x.vs))").alias("maps")), name).scalar()


def _rank_literal(spark: SparkSession, r: Ranks, buckets: int) -> Column:
    pairs = [(a * (r.edge + 1) + b, rank) for a, b, rank in r.pairs()]
    table = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([x for _, x in pairs], pa.int32())})
    return _as_literal(spark.createDataFrame(table), "pair", "rank", buckets, "bpe-ranks")


def _fold(word: str, r: Ranks, buckets: int) -> str:
    """SQL for the ids of a word; the lambda variable `ranks` holds the ranks of pairs.

    An element is a 64-bit number: rank of the pair that begins here (22 bits), place of its first byte (20), id (21). The
    smallest element is then the pair to merge.
    """
    none, low_21, place = 1 << 21, (1 << 21) - 1, ((1 << 20) - 1) << 21

    def element(left: str, right: str, at: str) -> str:
        pair = f"{left} * {r.edge + 1}L + {right}"
        return f"(shiftleft(coalesce(cast(ranks[pmod(hash({pair}), {buckets})][{pair}] as bigint), {none}L), 41) | {at} | {left})"

    byte_ids = f"array({', '.join(f'{i}L' for i in r.bytes)})"
    ids = f"transform(split(decode(cast({word} as binary), 'ISO-8859-1'), ''), c -> {byte_ids}[ascii(c)])"
    start = f"aggregate(array({ids}), cast(array() as array<bigint>), (_, ids) -> transform(ids, (a, i) -> {element('a', f'coalesce(get(ids, i + 1), {r.edge}L)', 'shiftleft(cast(i as bigint), 21)')}))"
    merged = "shiftright(low, 41)"
    whole = element(merged, f"coalesce(get(before, i + 2) & {low_21}, {r.edge}L)", f"(low & {place})")
    left = element(f"(x & {low_21})", merged, f"(x & {place})")
    step = f"""aggregate(array(array_min(s)), s, (before, low) -> IF(low >= {none << 41}L, before,
        transform(filter(before, (x, i) -> i = 0 OR before[i - 1] <> low), (x, i) -> CASE WHEN x = low THEN {whole} WHEN before[i + 1] = low THEN {left} ELSE x END)))"""
    return f"aggregate(sequence(2, octet_length({word})), {start}, (s, _) -> {step}, s -> transform(s, x -> cast(x & {low_21} as int)))"


def _count_chunks(batches):
    """Counts what stands between blanks; chunks that a task sees once at a time can't be frequent."""
    held: Counter[str] = Counter()

    def out():
        kept = [(w, n) for w, n in held.items() if n > 1 and len(w) <= FREQUENT_BYTES]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["chunk", "n"])

    for batch in batches:
        for text in batch.column("text"):
            held.update((text.as_py() or "").split(" "))
            if len(held) > HELD:
                yield out()
    yield out()


def frequent_words(docs: DataFrame, pattern: str, most: int = FREQUENT) -> DataFrame:
    """word, n: the words of all documents whose count at most `most` words reach."""
    chunks = docs.select("text").mapInArrow(_count_chunks, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
    words = chunks.select(F.explode(words_of(F.concat(F.lit(" "), "chunk"), pattern)).alias("word"), "n")
    words = settle(words.where(F.octet_length("word") <= FREQUENT_BYTES).groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    by_count = sorted(((x["n"], x["words"]) for x in words.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = 10_001, 0
    for n, count in by_count:
        total += count
        if total > most:
            break
        least = n
    return words.where(F.col("n") >= least)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, frequent: int = FREQUENT, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary: the ids turned back into bytes) for every document."""
    path, pattern, spark = path or default_vocabulary(), pattern or default_pattern(), docs.sparkSession
    r = ranks(path)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = {piece.decode(): rank for piece, rank in r.ids.items() if _is_text(piece)}
    whole = spark.createDataFrame(pa.table({"word": pa.array(pieces, pa.string())}))
    ranked = frequent_words(docs, pattern, frequent).join(whole, "word", "left_anti").select("word", _rank_literal(spark, r, buckets).alias("ranks"))
    folded = ranked.select("word", F.expr(f"transform(array(ranks), ranks -> {_fold('word', r, buckets)})[0]").alias("ids")).toArrow()
    known = pa.concat_arrays([pa.array(pieces, pa.string()), *folded["word"].chunks]), pa.concat_arrays([pa.array([[x] for x in pieces.values()], _IDS), *(c.cast(_IDS) for c in folded["ids"].chunks)])
    shared = spark.sparkContext.broadcast(known)

    def encode(batches):
        v = ranks(path)
        for batch in batches:
            ids = encoded(batch.column("words"), v, *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded(ids, v)], names=["doc_id", "ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", words_of(F.col("text"), pattern).alias("words")).mapInArrow(encode, f"doc_id {id_type}, ids array<int>, decoded binary")


_IDS = pa.list_(pa.int32())


def encoded(words: pa.Array, r: Ranks, known: pa.Array, known_ids: pa.Array) -> pa.Array:
    """The ids of texts given as lists of words: known words have their ids beside them, others are merged."""
    flat = words.flatten().dictionary_encode()
    at = pc.index_in(flat.dictionary, known)
    others = [r.learn(word) for word in flat.dictionary.filter(at.is_null()).to_pylist()]
    ends = np.cumsum([0, *map(len, others)])
    merged = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *others]), pa.int32()))
    place = at.fill_null(0).to_numpy().astype(np.int64)
    place[at.is_null().to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(others))
    by_word = pa.concat_arrays([known_ids, merged]).take(pa.array(place[flat.indices.to_numpy()], pa.int64()))
    of_texts = words.offsets.to_numpy() - words.offsets[0].as_py()
    return pa.ListArray.from_arrays(pa.array(by_word.offsets.to_numpy()[of_texts] - by_word.offsets[0].as_py(), pa.int32()), by_word.flatten())


def decoded(ids: pa.Array, r: Ranks) -> pa.Array:
    """The bytes of lists of ids; unknown ids are left out."""
    flat = ids.flatten().to_numpy()
    pieces = r.as_array().take(pa.array(np.where((flat >= 0) & (flat < r.edge), flat, 0), pa.int64(), mask=(flat < 0) | (flat >= r.edge)))
    ends = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
    of_texts = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends[of_texts].tobytes()), pieces.buffers()[2] or pa.py_buffer(b"")])


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, which has ids, with a column decoded: the pieces of the ids, one after the other. Unknown ids are left out."""
    path = path or default_vocabulary()

    def pieces(batches):
        for batch in batches:
            yield batch.append_column("decoded", decoded(batch.column("ids").cast(_IDS), ranks(path)))

    return df.mapInArrow(pieces, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def op11_byte_bpe(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    e = encode_documents(docs, path, **options)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def library_answer(text: str | None, path: str | None = None) -> tuple[int, str, str]:
    """What the tiktoken library gives, for tests."""
    e = library(path or default_vocabulary())
    ids = e.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(e.decode_bytes(ids)).hexdigest()


@lru_cache(maxsize=2)
def library(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=ranks(path).ids, special_tokens={})
