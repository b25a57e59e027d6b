"""Counts as the tokenizers library gives them."""

import random

import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quadlark.llm import tokencount as tc

PATH = public_tokenizers.path(tc.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


def want(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_against_library():
    c, rng = tc.counts(PATH), random.Random(2)
    parts = ["a", "e", "th", "ing", " ", "\n", "é", "1", "###", "  ", "日本", "😀", "'s", "'LL", "Q", "==", "́", "Σ", "ΑΣ ", "İ", "<|endoftext|>", "<|startoftext|>", "<|END", "\x85", "\x1c", "Ⅷ", "​", "K"]
    for _ in range(2500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert c.count(text) == want(text)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(text):
    assert tc.counts(PATH).count(text) == want(text)


def test_every_code_point():
    """Each one between letters, after an accented letter, and alone, against the library."""
    c = tc.counts(PATH)
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    wrong = []
    for s in range(0, len(points), 20000):
        texts = [f"Îa{x}b {x}" for x in points[s : s + 20000]]
        wrong += [t for t, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)) if c.count(t) != len(e.ids)]
    assert wrong == []


def test_marks_after_letters():
    """Letters with each combining mark, and two marks in both orders: composition is the library's."""
    import unicodedata

    c = tc.counts(PATH)
    marks = [chr(k) for k in range(0x110000) if unicodedata.category(chr(k))[0] == "M"] + [chr(k) for k in (0x1161, 0x11A8)]
    bases = ["a", "e", "ο", "क", "가", "ᄀ", "\U00011099", "\U000105d2", "\U0001611e"]
    texts = [b + m for b in bases for m in marks] + [b + m + n for b in bases[:4] for m in marks[::9] for n in ("\u0301", "\u0323")]
    assert [t for t, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)) if c.count(t) != len(e.ids)] == []


def test_long_text(make):
    """Megabytes in one text, and one word of a hundred thousand letters."""
    text = "The quick Übung 日本 42 " * 60_000 + "x" * 100_000
    row = tc.token_counts(make([(1, text)]), PATH).first()
    assert row.n_tokens == want(text) and row.over_limit and row.n_bytes == len(text.encode())


def test_proof_and_long_words():
    """Every proved string is one token alone; the heap for long words gives what the plain merge gives."""
    c = tc.counts(PATH)
    for word in random.Random(0).sample(sorted(c.whole), 300):
        assert c.merged(word) == 1
    long = "abthing" * 400
    assert c.merged(long) == want(long)


def test_table(make, odd):
    rows = sorted(((r.doc_id is None, r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(make(odd), PATH).collect())
    assert rows == sorted(((i is None, i), len((t or "").encode()), want(t or ""), want(t or "") > 2048) for i, t, *_ in odd)
    assert tc.token_counts(make([]), PATH).count() == 0
