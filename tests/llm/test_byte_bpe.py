"""Byte-level BPE against the tiktoken library."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import bytebpe

HARD = [
    (1, "ü ß é 中文 \U0001f600 don't I'LL it's 123abc4 \x85\u3000a"),
    (2, "a" * 300 + " " + "-" * 400 + "\n" * 300 + "  end"),
    (3, "\U0001f600" * 70 + " " * 100 + "x  y \ufeff\x00\x1c tab\tq"),
    (4, "\u0870\u0889x \U000323af\U0002ebf0 \u2177\u00b2 \U00010d40\U00010d41"),
    (5, "<|endoftext|> is plain text here"),
]


def generated(n, seed=5):
    r = random.Random(seed)
    pick = lambda: chr(r.choice([r.randint(32, 127), r.randint(160, 0x250), r.randint(0x370, 0x3000), r.randint(0x3000, 0xD7FF), r.randint(0xE000, 0x2FFFF), 32, 32, 10]))
    return [(100 + i, "".join(pick() for _ in range(r.randint(1, 120)))) for i in range(n)]


@pytest.mark.parametrize("frequent", [0, 100_000])
def test_ids_are_the_librarys(spark, table, odd, words, frequent):
    rows = HARD + generated(150) + odd + [(1000 + i, f"{words(i % 3, 40)}\n{words(7, 3)}") for i in range(30)]
    got = sorted((tuple(x) for x in bytebpe.op11_byte_bpe(table(rows), frequent=frequent).collect()), key=repr)
    assert got == sorted(((i, *bytebpe.library_answer(t)) for i, t in rows), key=repr)


def test_decoding_gives_the_text_back(spark, table, odd):
    rows = HARD + [(i, t) for i, t in odd if i is not None]
    for x in bytebpe.encode_documents(table(rows), frequent=10).collect():
        assert bytes(x.decoded) in {(t or "").encode() for i, t in rows if i == x.doc_id}


def test_unknown_ids_are_left_out(spark):
    df = spark.createDataFrame([([0, 10**6, 1],), ([],)], "ids array<int>")
    r = bytebpe.ranks(bytebpe.default_vocabulary())
    assert sorted(bytes(x.decoded) for x in bytebpe.decode(df).collect()) == [b"", r.pieces[0] + r.pieces[1]]


def test_a_small_vocabulary_of_its_own(spark, table, tmp_path):
    """A pair whose rank is smaller than that of its own parts is merged in the library's order."""
    import base64

    import tiktoken

    pieces = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"abab", b"ca"]
    path = tmp_path / "own.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(pieces)))
    texts = [(i, "".join(random.Random(i).choice("abc") for _ in range(1 + i % 20))) for i in range(200)]
    own = tiktoken.Encoding("own", pat_str=bytebpe.default_pattern(), mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    for frequent in (0, 10**6):
        rows = texts * 2 if frequent else texts  # words that a task sees twice are folded
        got = {x.doc_id: x.ids for x in bytebpe.encode_documents(table(rows).coalesce(1), str(path), frequent=frequent, buckets=64).collect()}
        assert got == {i: own.encode_ordinary(t) for i, t in texts}


def test_known_and_other_words_go_to_their_places():
    r = bytebpe.ranks(bytebpe.default_vocabulary())
    words = pa.array([["k"], [], ["k", "hello there", " zqx", "k", "l"], [" zqx"], ["l"]], pa.list_(pa.string()))
    known, ids = pa.array(["l", "k"]), pa.array([[4], [1, 2]], pa.list_(pa.int32()))
    b, c = (r.merge(w) for w in (b"hello there", b" zqx"))
    for cut in (0, 1, 2, 5):
        assert bytebpe.encoded(words.slice(cut), r, known, ids).to_pylist() == [[1, 2], [], [1, 2, *b, *c, 1, 2, 4], c, [4]][cut:]
    some = pa.array([[0, 1], [], [10**7, 5, -1]], pa.list_(pa.int32()))
    for cut in (0, 1, 2, 3):
        assert bytebpe.decoded(some.slice(cut), r).to_pylist() == [r.pieces[0] + r.pieces[1], b"", r.pieces[5]][cut:]


def test_empty_table_and_clashing_columns(spark, table):
    assert bytebpe.op11_byte_bpe(table([])).count() == 0
    df = table([(1, "a b")])
    for name in ("ids", "words", "known", "_pieces", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    assert [tuple(x) for x in bytebpe.op11_byte_bpe(df, frequent=10).collect()] == [(1, *bytebpe.library_answer("a b"))]
