"""Byte-pair encoding and decoding with a contiguous rank array per word.

Method. A word's parts stand in one list of boundaries with, beside each, the rank of the pair that starts there. The
smallest rank is found by scanning the list; its right boundary is deleted and the two neighbouring ranks are looked up
again, until no pair has a rank. That is quadratic in a word, so words over LONG_WORD bytes take the same merges from a
heap over linked parts. Texts with characters whose Unicode properties differ between versions are normalised and split by
the library. What stands between white space and was seen before comes from a bounded cache in each worker.

The vocabulary is a tokenizer file (JSON, word-end BPE): NFC, white space to a space, lower case, the file's split
expression, bytes as printable characters. Ids equal those of the tokenizers library on the same file.

Defined results. Null text is empty; an empty text has no ids and decodes to an empty text. The strings of special tokens
within a text become their ids, as the library does by default. Repeated rows give a row each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import byte_chunks

#: Bytes of a word from which on the heap takes over from the scan.
LONG_WORD = 256
#: Chunks and words that a worker remembers.
CACHE_WORDS = 250_000

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")
_FULL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
#: Characters whose properties no version of Unicode has changed or will; texts with others are split by the library itself.
_RARE = re.compile("[^\x00-\u024f\u2010-\u2027]")
_NONE = 1 << 60


def trim(cache: dict, most: int = CACHE_WORDS) -> None:
    """Drops the newer half of a full cache: what came first is, as a rule, what comes most often."""
    if len(cache) >= most:
        for key in list(islice(reversed(cache), most // 2)):
            del cache[key]


class _Word(str):
    """A chunk that is one word already."""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.ids[a] << 32 | self.ids[b]] = (rank, self.ids[a + b])
        chars = _byte_characters()
        self.bytes = [self.ids[c] for c in chars]
        self.ends = [self.ids[c + self.suffix] for c in chars]
        self.cache: dict[str, bytes] = {}
        self.path, self.back = path, {c: b for b, c in enumerate(chars)}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        parts = [self.bytes[b] for b in word[:-1]] + [self.ends[word[-1]]]
        return self._merge_long(parts) if len(parts) > LONG_WORD else self._merge_short(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        get = self.pairs.get
        found = [get(parts[i] << 32 | parts[i + 1]) for i in range(len(parts) - 1)]
        ranks = [x[0] if x else _NONE for x in found]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            parts[i] = get(parts[i] << 32 | parts[i + 1])[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                x = get(parts[i] << 32 | parts[i + 1])
                ranks[i] = x[0] if x else _NONE
            if i:
                x = get(parts[i - 1] << 32 | parts[i])
                ranks[i - 1] = x[0] if x else _NONE
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        get, n = self.pairs.get, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def push(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (x := get(parts[i] << 32 | parts[right[i]])):
                heapq.heappush(heap, (x[0], i, parts[i], parts[right[i]], x[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i])
            push(i)
        return [p for p in parts if p >= 0]

    def chunks(self, text: str) -> list[str]:
        """The normalised text, which holds no special token, cut at white space; no word crosses a cut."""
        if text.isascii():
            text = text.lower()
        elif _RARE.search(text):
            return self._split_by_library(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if _SEPARATORS.search(text):  # str.split() takes these four for white space, the file doesn't
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def _split_by_library(self, text: str) -> list[str]:
        if not hasattr(self, "library"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [_Word(bytes([self.back[c] for c in p]).decode("utf-8", "surrogatepass")) for p, _ in pieces]

    @staticmethod
    def words(chunk: str) -> list[str]:
        """The words of a chunk by the file's expression."""
        if type(chunk) is _Word or chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # the common case, without an expression
            return [chunk[:-1], chunk[-1]]
        return _ASCII.findall(chunk) if chunk.isascii() else _FULL.findall(chunk)

    def parts(self, text: str) -> list[str]:
        """Ordinary stretches at even places, special tokens at odd ones."""
        return self.split_special.split(text) if self.split_special and "<|" in text else [text]

    def _learn(self, chunk: str) -> bytes:
        cache = self.cache
        trim(cache)
        out = []
        for w in self.words(chunk):
            ids = cache.get(w)
            if ids is None:
                ids = array("I", self.merge(w.encode())).tobytes()
                if len(w) <= LONG_WORD:
                    cache[w] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(chunk) <= LONG_WORD:
            cache[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, 32 bits each."""
        get, learn, out = self.cache.get, self._learn, []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out += [get(c) or learn(c) for c in self.chunks(part)]
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens as they stand, a space between them; unknown ids are left out."""
        get = self.tokens.get
        return " ".join([t for i in ids if (t := get(i)) is not None])

    def text(self, ids: list[int]) -> str:
        """Readable text again, lower case, words apart by one space."""
        joined = "".join(self.tokens[i] for i in ids).replace(self.suffix, " ") if self.suffix else "".join(self.tokens[i] for i in ids)
        return b"".join(bytes([self.back[c]]) if c in self.back else c.encode() for c in joined).decode("utf-8", "replace").rstrip(" ")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (the ids turned back into text) for every document."""
    path = path or default_vocabulary()

    def encode(batches):
        v = vocabulary(path)
        for batch in batches:
            for first, texts in byte_chunks(batch.column("text")):
                packed = [v.encode(t.decode("utf-8", "replace")) for t in texts]
                decoded = [v.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in packed]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {id_type}, ids binary, decoded string")


def op4_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    e = encode_documents(docs, path)
    return e.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def library_answer(text: str | None, path: str | None = None) -> tuple[int, str, str]:
    """What the tokenizers library gives, for tests."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or default_vocabulary())
    ids = t.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
