"""Token-id files in Simple-8b word-aligned coding.

Format. A data set is a folder of Parquet files, which any store that Spark writes can hold; a row is a block and stands
by itself:

    part, block      place of the block; parts, blocks and documents within ascend by doc_id
    first            token ids before the block within its part
    doc_ids, sizes   the block's documents and their numbers of ids
    n_words          length of `words`
    offsets          (word, id) at which every STRIDE-th word begins, to decode from the middle
    words            Simple-8b words, 64 bits little-endian

A word has a selector in its high 4 bits and packs WIDTHS[selector] ids below, the first in the lowest bits. Selector 15
escapes: the whole next word is one id (for ids of 60 bits or more). The last word may pack fewer ids than its selector
says; `sizes` tells how many count. Encoding and decoding work on all words of one selector at a time.

Method. Executors encode texts map-side; ids cross the one exchange as 16-bit (or 32-bit) numbers, dealt by doc_id into
ranges whose bounds come from the doc_id column alone. The number of ranges follows the texts' bytes, summed where they are
read; no text is moved or sampled for it. Bounds are broadcast and found by binary search, 8 bytes a part. A task sorts its
range and cuts blocks at documents; a document never spans blocks.

Defined results. Null text is empty: its one id is the end id. A null doc_id sorts first. Documents that share a doc_id
keep a row each, ordered by their ids within a part. An empty table gives an empty data set.
"""

from __future__ import annotations

import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG_WORD, Vocabulary, default_vocabulary, trim, vocabulary
from .common import byte_chunks, scratch_path, until_exit

#: Ids to a word and their bits, by selector; selector 15 is the escape.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_BITS = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)
#: Ids after which a block ends, and words between two offsets.
BLOCK_IDS = 1 << 17
STRIDE = 1024
#: Text bytes of a part at most, as a rule.
PART_BYTES = 256 << 20
#: Chunks whose ids a worker remembers.
CACHE_CHUNKS = 1_000_000

BLOCK = "part int, block int, first bigint, doc_ids array<bigint>, sizes array<bigint>, n_words bigint, offsets array<bigint>, words binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of unsigned integers, and the number of values each word packs."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    bits = np.zeros(n + 64, dtype=np.uint8)  # zeros after the end let the last word be short
    if int(values.max()) < 1 << 16:
        bits[:n] = _BITS[values.astype(np.uint16)]
    else:
        for shift in range(0, 64, 16):  # the highest 16 bits that aren't 0 decide
            piece = (values >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.uint16)
            bits[:n] = np.where(piece > 0, _BITS[piece] + np.uint8(shift), bits[:n])
    top, span = {1: bits}, 1
    while span < 32:  # largest of each run of 2, 4, 8, 16, 32
        top[span * 2] = np.maximum(top[span][: len(bits) - span], np.concatenate((top[span][span:], np.zeros(max(0, len(bits) - span - len(top[span][span:])), np.uint8))))
        span *= 2
    choice = np.full(n, ESCAPE, dtype=np.uint8)
    for s in range(len(WIDTHS) - 1, -1, -1):
        size, width = WIDTHS[s]
        half = 1 << (size.bit_length() - 1)
        half = min(half, 32)
        a = top[half]
        reach = [a[:n], a[size - half : size - half + n]] if size <= 2 * half else [a[i : i + n] for i in range(0, size, half)]
        widest = reach[0]
        for x in reach[1:]:
            widest = np.maximum(widest[: len(x)], x) if len(x) == len(widest) else np.maximum(widest, np.concatenate((x, np.zeros(len(widest) - len(x), np.uint8))))
        choice[widest <= width] = s
    steps = np.array([w[0] for w in WIDTHS] + [0, 1], dtype=np.int64)[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, dtype=np.int64)
    chosen = choice[starts]
    slots = 1 + (chosen == ESCAPE)
    place = np.cumsum(slots) - slots
    out, holds = np.zeros(int(slots.sum()), dtype=np.uint64), np.zeros(int(slots.sum()), dtype=np.int64)
    padded = np.concatenate((values, np.zeros(64, dtype=np.uint64)))
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        to, frm = place[mine], starts[mine]
        if s == ESCAPE:
            out[to] = np.uint64(ESCAPE << 60)
            out[to + 1], holds[to + 1] = padded[frm], 1
            continue
        size, width = WIDTHS[s]
        word = np.full(len(to), s << 60, dtype=np.uint64)
        for j in range(size):
            word |= padded[frm + j] << np.uint64(j * width)
        out[to], holds[to] = word, np.minimum(size, n - frm)
    return out, holds


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of Simple-8b words, all words of a selector at once."""
    words = np.asarray(words, dtype=np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (chosen == ESCAPE).any():  # a word after an escape is a value, whatever its high bits
        kinds = chosen.tolist()
        i = 0
        while i < len(kinds):
            if kinds[i] == ESCAPE:
                raw[i + 1] = True
                i += 1
            i += 1
        chosen[raw] = -1
    sizes = np.array([w[0] for w in WIDTHS] + [0, 0], dtype=np.int64)[np.maximum(chosen, 0)]
    sizes[raw] = 1
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint64)
    out[first[raw]] = words[raw]
    for s in np.unique(chosen).tolist():
        if s in (-1, ESCAPE):
            continue
        mine = chosen == s
        size, width = WIDTHS[s]
        mask = np.uint64((1 << width) - 1)
        for j in range(size):
            out[first[mine] + j] = words[mine] >> np.uint64(j * width) & mask
    return out[:n]


def unpack_from(words: np.ndarray, offsets: list[int], start: int, n: int) -> np.ndarray:
    """Values start to start + n of a block, decoded from the offset before them."""
    pairs = np.asarray(offsets, dtype=np.int64).reshape(-1, 2)
    k = max(0, int(np.searchsorted(pairs[:, 1], start, "right")) - 1)
    word, id_ = pairs[k] if len(pairs) else (0, 0)
    return unpack(words[word:], start - id_ + n)[start - id_ :]


class LibraryEncoder:
    """Ids by the tokenizers library, which sees each word once: texts are cut where the file cuts them, and new words go
    to the library many at a time, joined by spaces; a word ends where a token carries the word-end suffix."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.split, self.kind, self.cache = vocabulary(path), kind, {}
        self.tokenizer = Tokenizer(Tokenizer.from_file(path).model)  # normalised words only: no normaliser again
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(self.split.tokens) + 1, dtype=bool)
        self.ends[[i for i, t in self.split.tokens.items() if t.endswith(self.split.suffix)]] = True

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """word -> ids, as bytes."""
        out = {}
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            after = ((np.flatnonzero(self.ends[ids]) + 1) * np.dtype(self.kind).itemsize).tolist()
            raw, at = ids.astype(self.kind).tobytes(), 0
            for w, to in zip(some, after, strict=True):
                out[w] = raw[at:to]
                at = to
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        v: Vocabulary = self.split
        cache, end = self.cache, {}
        trim(cache, CACHE_CHUNKS)
        found: list[list[bytes | None]] = []  # each text's ids, chunk by chunk
        at: list[int] = []  # where a chunk isn't known yet: text, place and chunk, in three plain lists that the garbage collector needn't walk
        place: list[int] = []
        what: list[str] = []
        for t in texts:
            ids: list[bytes | None] = []
            for k, p in enumerate(v.parts(t)):
                if k % 2:
                    ids.append(end.setdefault(p, np.array([v.special[p]], dtype=self.kind).tobytes()))
                    continue
                chunks = v.chunks(p)
                got = list(map(cache.get, chunks))
                if None in got:
                    some = [i for i, x in enumerate(got) if x is None]
                    at += [len(found)] * len(some)
                    place += [len(ids) + i for i in some]
                    what += [chunks[i] for i in some]
                ids += got
            found.append(ids)
        new = {c: v.words(c) for c in set(what)}
        fresh = self.learn(list({w for words in new.values() for w in words if w not in cache}))
        cache.update((w, x) for w, x in fresh.items() if len(w) <= LONG_WORD)
        for c, words in new.items():
            fresh[c] = b"".join([fresh[w] if w in fresh else cache[w] for w in words])
            if len(c) <= LONG_WORD:
                cache[c] = fresh[c]
        for k, i, c in zip(at, place, what, strict=True):
            found[k][i] = fresh[c]
        return list(map(b"".join, found))


@lru_cache(maxsize=2)
def _encoder(path: str, kind: str) -> LibraryEncoder:
    return LibraryEncoder(path, kind)


def encode_ids(docs: DataFrame, path: str, end_id: int, wide: bool, bounds: np.ndarray) -> DataFrame:
    """part, doc_id and ids (binary, 16 or 32 bits each), the end id after each document. bounds, in order: parts begin behind them; a doc_id that is a bound several times has as many parts."""
    kind = "<u4" if wide else "<u2"
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(bounds))

    def encode(batches):
        e, end = _encoder(path, kind), np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            for first, texts in byte_chunks(batch.column("text")):
                ids = [x + end for x in e.encode([t.decode("utf-8", "replace") for t in texts])]
                of = batch.column("doc_id").slice(first, len(texts)).cast(pa.int64())
                key = of.fill_null(0).to_numpy()
                below = np.searchsorted(shared.value, key, "left")
                alike = np.searchsorted(shared.value, key, "right") - below
                if alike.max() > 1:
                    below += np.fromiter(map(zlib.crc32, ids), np.int64, len(ids)) % np.maximum(alike, 1)
                part = np.where(of.is_null().to_numpy(zero_copy_only=False), 0, below)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), of, pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "part int, doc_id bigint, ids binary")


def default_parts(docs: DataFrame) -> int:
    """As many parts as a shuffle has, more where the texts would make parts of over PART_BYTES. Sizes are summed where the texts are read: no text is moved for it."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))


def _blocks(kind: str):
    def build(batches):
        part = None
        state = {"block": 0, "first": 0, "total": 0}
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def flush():
            ids = np.concatenate(held) if held else np.zeros(0, dtype=kind)
            words, holds = pack(ids)
            before = np.cumsum(holds) - holds
            # an offset never falls between an escape and its value: that value's word holds 1 and the escape 0
            marks = [i - 1 if i and holds[i - 1] == 0 and holds[i] == 1 and words[i - 1] >> np.uint64(60) == ESCAPE else i for i in range(0, len(words), STRIDE)]
            row = {"part": part, "block": state["block"], "first": state["first"], "doc_ids": list(docs), "sizes": [len(h) for h in held], "n_words": len(words), "offsets": [int(x) for i in marks for x in (i, before[i])], "words": words.astype("<u8").tobytes()}
            state["block"] += 1
            state["first"] += len(ids)
            state["total"] = 0
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for batch in batches:
            for p, doc_id, raw in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if part is not None and p != part:
                    if held:
                        yield flush()
                    state.update(block=0, first=0)
                part = p
                ids = np.frombuffer(raw, dtype=kind)
                docs.append(doc_id)
                held.append(ids)
                state["total"] += len(ids)
                if state["total"] >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return build


SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_words", pa.int64()), ("offsets", pa.list_(pa.int64())), ("words", pa.binary())])


def write_token_files(docs: DataFrame, out: str, *, path: str | None = None, end_id: int = 2, parts: int | None = None) -> None:
    """Writes the documents' ids to `out`, by doc_id, in `parts` tasks. Documents of one doc_id stand by their ids; where it has several parts, they are dealt over them by a hash of their ids and stand in order within each."""
    path = path or default_vocabulary()
    wide = max(max(vocabulary(path).tokens), end_id) >= 1 << 16
    parts = parts or default_parts(docs)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts))).first()[0] or []
    ids = encode_ids(docs, path, end_id, wide, np.array(cuts if parts > 1 else [], dtype=np.int64))
    dealt = ids.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(_blocks("<u4" if wide else "<u2"), BLOCK).write.parquet(out)


def read_token_files(spark, out: str) -> DataFrame:
    """doc_id, part, at (ids of the part before the document) and ids (binary, 32 bits each), decoded from the files."""

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                ids = unpack(np.frombuffer(row["words"], dtype="<u8"), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                raw = [ids[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(sizes), pa.int32()), pa.array(row["first"] + ends - sizes, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "part", "at", "ids"])

    return spark.read.schema(BLOCK).parquet(out).mapInArrow(decode, "doc_id bigint, part int, at bigint, ids binary")


def op8_token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    out = scratch_path(spark, "tokens")
    write_token_files(docs, out, path=path)
    until_exit(spark, out)
    totals = spark.read.schema(BLOCK).parquet(out).groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, total = [], 0  # one entry a part: as many as there are tasks, not rows
    for r in totals:
        before.append((r["part"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "part int, before bigint"))
    ids = read_token_files(spark, out).join(starts, "part")
    return ids.select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def library_answer(docs: list[tuple[int, str | None]], path: str | None = None, end_id: int = 2) -> list[tuple[int, int, int, int]]:
    """What the contract asks for, by plain calls of the library, for tests."""
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(path or default_vocabulary()), 0, []
    for doc_id, text in sorted(docs, key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out
