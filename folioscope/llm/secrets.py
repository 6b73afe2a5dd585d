"""Secret scanning: an Aho-Corasick keyword prefilter, anchored expressions only near hits, embedded checksums.

Method. One automaton holds every rule's keyword; a single pass over a text's lower-cased form (A-Z only, so positions
stay) gives keyword hits. At each hit the rule's expression is tried at that one place and nowhere else. Rules that carry
their own check (CRC-32 in base 62, mod-97, JSON of a web token) keep a match only if it holds. A web token's parts have no
bound, so a run of its letters is split once, however often its keyword stands in it. Long hexadecimal runs have no
keyword; a bounded expression finds them in one linear pass.

Defined results. Null text counts as empty; an empty text has no spans. A kind's matches are leftmost and don't overlap;
kinds may overlap each other. Repeated rows give a row each. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks

#: Base kinds first, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "forge_token", "registry_token", "jwt", "chat_token", "private_key", "iban_like")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_FORGE = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_REGISTRY = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{16,}")
_JWT_RUN, _JWT_REST = re.compile(r"[0-9A-Za-z_-]*"), re.compile(r"\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{16,}")
_CHAT = re.compile(r"xox[abprs]-[0-9]{8,14}-[0-9A-Za-z-]{16,}")
_KEY = re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----")
_IBAN = re.compile(r"IBAN[:\x20]{0,3}([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Z0-9])")

_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS62[r] + out
    return out.rjust(6, "0")


def _crc_holds(m: re.Match) -> bool:
    return _base62(zlib.crc32(m[1].encode())) == m[2]


def _jwt_holds(m: re.Match) -> bool:
    """The header and the claims are JSON objects, and the header names an algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in m[0].split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and "alg" in head


def _mod97_holds(m: re.Match) -> bool:
    moved = m[1][4:] + m[1][:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


#: kind -> keywords as lower case, expression, and whether a match is kept.
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (("akia",), _ACCESS, lambda m: len(m[0]) >= 16),
    "forge_token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _FORGE, _crc_holds),
    "registry_token": (("npm_",), _REGISTRY, _crc_holds),
    "jwt": (("eyj",), _JWT, _jwt_holds),
    "chat_token": (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), _CHAT, lambda m: True),
    "private_key": (("-----begin ",), _KEY, lambda m: True),
    "iban_like": (("iban",), _IBAN, _mod97_holds),
}


def _automaton() -> ahocorasick.Automaton:
    owners = defaultdict(list)
    for kind, (words, _, _) in RULES.items():
        for w in words:
            owners[w].append(kind)
    auto = ahocorasick.Automaton()
    for w, kinds in owners.items():
        auto.add_word(w, (len(w), tuple(kinds)))
    auto.make_automaton()
    return auto


_AUTO = None


def find(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in a UTF-8 text, sorted by start and then KINDS."""
    global _AUTO
    if _AUTO is None:
        _AUTO = _automaton()
    text = raw.decode("utf-8", "replace")
    starts: dict[str, list[int]] = {}
    for end, (size, kinds) in _AUTO.iter(raw.lower().decode("utf-8", "replace")):  # bytes.lower() touches A-Z only
        for kind in kinds:
            starts.setdefault(kind, []).append(end - size + 1)
    out = [(*m.span(), "hex") for m in _HEX.finditer(text)]
    for kind, places in starts.items():
        _, pattern, keep = RULES[kind]
        free = run = 0
        for at in sorted(set(places)):
            if kind == "jwt" and at >= max(free, run):
                run = _JWT_RUN.match(text, at).end()
                if not _JWT_REST.match(text, run):
                    free = run  # nothing that starts in this run can match
            if at >= free and (m := pattern.match(text, at)):
                free = m.end()  # a match that fails its test still takes its place
                if keep(m):
                    out.append((*m.span(), kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and found: all spans of a document as (start, end, kind), by start and then kind."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches):
        for batch in batches:
            for first, texts in byte_chunks(batch.column("text")):
                found = [[{"start": a, "end": b, "kind": k} for a, b, k in find(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(found, kind)], names=["doc_id", "found"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, found array<struct<start:bigint,end:bigint,kind:string>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every found span replaced by mark; overlapping spans become one. Other columns stay."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for a, b, _ in find(t.encode()):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return texts.map(one)

    return docs.withColumn("text", clean("text"))


def op10_secret_scan(docs: DataFrame) -> DataFrame:
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    found, base = F.col("found"), F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan_secrets(docs).select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(found, label), ",").alias("spans"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base rules by finditer over the whole text, for tests."""
    text = text or ""
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [
        *((*m.span(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 8),
        *((*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16),
        *((*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32),
    ]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    n = [sum(k == x[2] for x in found) for k in BASE]
    return (*n, hashlib.sha256(_listed(found).encode()).hexdigest())
