"""Held-out accuracy, letters and edge cases."""

import numpy as np

from quadlark.llm import langid as li
from quadlark.llm.common import table


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in table(spark, d, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in li.op8(spark, d).collect() if r.held_out]
    assert len(rows) > 100 and np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_trigrams():
    s = li.Space(64)
    assert len(s.trigrams("")) == len(s.trigrams("12 #!")) == 0
    assert len(s.trigrams("a")) == 1 and list(s.trigrams("Ab, c")) == list(s.trigrams("..aB   C!"))


def test_cache_starts_anew():
    """A small cache gives the same vectors as a large one."""
    a, b = li.Space(64, most=400), li.Space(64)
    for text in ("the quick brown fox " * 3, "größe der straße", "el niño pequeño", "the quick brown fox"):
        assert np.array_equal(a.bundle(a.trigrams(text)), b.bundle(b.trigrams(text)))


def test_bundle_is_a_sum():
    s = li.Space(32)
    g = s.trigrams("abcab")
    whole = s.bundle(g)
    assert np.array_equal(whole, sum(s.bundle(g[i : i + 1]) for i in range(len(g))))


def test_odd_rows(make, odd):
    docs = make([*odd, (30, "und der die das ist", "de"), (31, "the and of that is", "en")])
    learned = li.prototypes(docs)
    assert list(learned) == ["de", "en"]
    got = {(r.doc_id, r.lang_pred): r.score for r in li.identify(docs, learned).collect()}
    assert got[1, "und"] == got[2, "und"] == got[3, "und"] == 0.0
    assert (30, "de") in got and (31, "en") in got
    assert li.identify(make([]), learned).count() == 0
    assert {r.lang_pred for r in li.identify(docs, li.prototypes(make([]))).collect()} == {"und"}


def slow_bundle(text, dimensions=li.DIMENSIONS, seed=17):
    """One trigram after the other, from each letter's own vector."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    total, n = np.zeros(dimensions), 0
    if letters:
        line = " " + " ".join(letters) + " "
        for k in range(len(line) - 2):
            v = [li.letter_vector(0 if c == " " else ord(c), dimensions, seed).astype(int) for c in line[k : k + 3]]
            total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
            n += 1
    return total, n


def test_against_brute_force(make):
    """Predictions and scores, letter by letter, in several scripts."""
    train = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "кошка и собака", "ru"), (4, "猫和狗在一起", "zh"), (5, "犬と猫がいる", "ja"), (6, "the end", "en")]
    asked = [(10, "the dog"), (11, "le chien"), (12, "собака"), (13, "猫和狗在一起的"), (14, "猫がいる"), (15, "größer 12"), (16, "!!")]
    sums = {}
    for _, text, lang in train:
        v, n = slow_bundle(text)
        sums[lang] = sums.get(lang, 0) + v / n
    names = sorted(sums)
    protos = [sums[x] / np.linalg.norm(sums[x]) for x in names]
    got = {r.doc_id: r for r in li.identify(make(asked), li.prototypes(make(train))).collect()}
    for i, text in asked:
        v, n = slow_bundle(text)
        if not n:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosine = np.array([p @ v / np.linalg.norm(v) for p in protos])
        best = int(np.argmax(cosine))
        assert got[i].lang_pred == names[best]
        assert abs(got[i].score - 1 / np.exp(40 * (cosine - cosine[best])).sum()) < 1e-6
    assert [got[i].lang_pred for i in range(10, 15)] == ["en", "fr", "ru", "zh", "ja"]


def test_letters_share_no_vector():
    points = [ord(c) for c in "aeéñßжя中文字猫狗犬かな한글"] + [0, 0x4E00, 0x4E00 + 165]
    v = np.stack([li.letter_vector(p, 2048, 17).astype(int) for p in points])
    off = v @ v.T - 2048 * np.eye(len(points))
    assert np.abs(off).max() < 300


def test_long_text(make):
    text = "the quick brown fox " * 150_000
    learned = li.prototypes(make([(1, text, "en"), (2, "der schnelle braune fuchs", "de")]))
    assert [r.lang_pred for r in li.identify(make([(3, text)]), learned).collect()] == ["en"]
