"""Ids as the tiktoken library gives them; streaming decode; edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from quadlark.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_against_library(library):
    rng, e = random.Random(1), bpe.encoder(PATH)
    parts = ["a", "th", "ing", " ", "\n", "é", "ß", "1", "###", "$", "  ", "日本", "😀", "'s", "'ll", "zz", "aaaa", "́", "<|endoftext|>", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = e.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(bpe.decode(ids, e.fst.text, 3)) == text


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(text):
    e = bpe.encoder(PATH)
    ids = e.encode(text)
    assert b"".join(e.fst.text[i] for i in ids).decode() == text == "".join(bpe.decode(ids, e.fst.text))


def test_followers():
    f, rng = bpe.encoder(PATH).fst, random.Random(4)
    usable = [i for i, t in f.text.items() if len(t) == 1 or i in f.halves]
    for _ in range(20000):
        a, b = rng.choice(usable), rng.choice(usable)
        assert f.may_follow(a, b) == ([f.ranks[x] for x in bpe.merge(f.text[a] + f.text[b], f.ranks)] == [a, b])


def test_stream_and_small_memory(library):
    """Bounded lookahead in small steps, and a transducer that starts its states anew all the time."""
    f, rng = bpe.Transducer(bpe.read_ranks(PATH), most=5), random.Random(3)
    for _ in range(60):
        piece = "".join(rng.choice(["a", "e", "th", "ing", "ou", "xq", "-"]) for _ in range(rng.randint(1, 300))).encode()
        want = library._core_bpe.encode_single_piece(piece)
        assert [i for part in f.stream(piece, 16) for i in part] == want == f.encode(piece)
    long = ("ab" * 40000).encode()
    assert len(f.encode(long)) == len(library._core_bpe.encode_single_piece(long[:800])) * 100


@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine(data, step):
    s = bpe.Utf8Stream()
    got = "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.end()
    assert got == data.decode("utf-8", "replace")


def test_table(spark, make, odd, library):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(make(odd), PATH).collect()}
    want = set()
    for i, text, *_ in odd:
        ids = library.encode_ordinary(text or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows == want
    assert bpe.round_trip(make(odd), PATH).count() == len(odd)
    assert bpe.round_trip(make([]), PATH).count() == 0
    kept = bpe.round_trip(make(odd), PATH, keep_ids=True).where("doc_id = 7").first()
    assert kept.ids == library.encode_ordinary(odd[-1][1])


@pytest.mark.parametrize("keep_ids", [False, True])
@pytest.mark.parametrize("place", [None, "h"])
def test_columns(make, keep_ids, place):
    """Every choice of further columns, with and without a place."""
    row = bpe.round_trip(make([(3, "one two")]), PATH, keep_ids, place).first().asDict()
    assert list(row) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["place"] * bool(place)
    assert row["n_tokens"] == len(row.get("ids", [1, 2])) and row.get("place", 1) == 1


def test_query(spark, library):
    """op3 over a whole table, as the library gives it."""
    d = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in bpe.op3(spark, d).collect()) == sorted(want)
