"""Repeated passages against brute force over all passages; bytes decide."""

import random
from collections import defaultdict

import pytest

from quadlark.llm import linededup as ld


def line(rng, n=20):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(n))


def numbered(text):
    lines = (text or "").split("\n")
    return lines, [k for k, x in enumerate(lines) if x.strip()]


def repeated(rows, long_line=50):
    """Brute force on the texts themselves: the lines with words of every repeated passage of two lines or more, or of one long line, but
    its first place's. Also which of them stand in a passage of at least three lines that some one earlier place holds too."""
    places, covered, whole = defaultdict(list), defaultdict(set), defaultdict(set)
    for i, text in rows:
        lines, full = numbered(text)
        for a, k in enumerate(full):
            for n in (2, 3):
                if a + n <= len(full):
                    places[tuple(lines[x] for x in full[a : a + n])].append((i, a))
            if len(lines[k].split()) >= long_line:
                places[lines[k],].append((i, a))
    texts = {i: numbered(t)[1] for i, t in rows}
    for passage, at in places.items():
        for i, a in sorted(at)[1:]:
            there = {texts[i][a + k] for k in range(len(passage))}
            covered[i] |= there
            if len(passage) == 3:
                whole[i] |= there
    return covered, whole


def corpus(seed):
    rng = random.Random(seed)
    shared = [[line(rng) for _ in range(rng.randint(2, 7))] for _ in range(8)] + [[line(rng, 70)]]
    rows = []
    for i in range(80):
        lines = [line(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(shared)
            if rng.random() < 0.2:
                lines.insert(rng.randint(0, len(lines)), " ")
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(make, seed):
    """Nothing goes that brute force doesn't find; 0.9 of what it finds goes, and all of each passage of three lines; no line is lost."""
    rows = corpus(seed)
    want, whole = repeated(rows)
    got = {r.doc_id: r for r in ld.remove_repeats(make(rows)).collect()}
    found, every = 0, 0
    for i, text in rows:
        lines, full = numbered(text)
        gone = set(got[i]["__removed"]) & set(full)
        assert gone <= want[i] and whole[i] <= gone
        found += len(gone)
        every += len(want[i])
        assert got[i].text == "\n".join(x for k, x in enumerate(lines) if k not in got[i]["__removed"])
    assert found >= 0.9 * every > 0
    before = {x for _, t in rows for x in t.split("\n") if x.strip()}
    assert before == {x for r in got.values() for x in r.text.split("\n") if x.strip()}


def test_recall_on_the_tables(spark):
    """On documents of sf0.01, of all lines in repeated passages of any two lines or more."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want, whole = repeated(rows)
    gone = {r.doc_id: set(r["__removed"]) for r in ld.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(len(gone[i] & want[i]) for i in want)
    assert found >= 0.97 * sum(map(len, want.values()))
    assert all(gone[i] & set(numbered(t)[1]) <= want[i] for i, t in rows)


def test_boundaries():
    """Chosen by the lines around a place alone, and in any WINDOW consecutive places there is one."""
    rng = random.Random(3)
    values = [rng.randrange(10**6) for _ in range(400)]
    at = ld.boundaries(values)
    assert 200 < len(at) < 320 and all(b - a <= ld.WINDOW for a, b in zip(at, at[1:]))
    assert ld.boundaries([]) == [] and ld.boundaries([5]) == [0]
    moved = {x - 7 for x in ld.boundaries([rng.randrange(10**6) for _ in range(7)] + values)}
    assert {x for x in moved if x > 1} == {x for x in at if x > 1}
    hashes = [rng.randrange(1, 1 << 64) for _ in range(30)]
    assert ld.rolled(hashes)[5:] == ld.rolled(hashes[5:]) and ld.rolled(hashes, 3)[9] == ld.rolled(hashes[9:12], 3)[0]


def test_copies_and_short_passages(make):
    rng = random.Random(5)
    text = "\n".join(line(rng) for _ in range(5))
    rows = [(1, text), (2, text), (3, "All rights reserved.\nOne more line."), (4, "All rights reserved.\nOne more line."), (5, "All rights reserved."), (6, "All rights reserved.\nAnother end.")]
    assert {r.doc_id: r.text for r in ld.remove_repeats(make(rows)).collect()} == {1: text, 2: "", 3: rows[2][1], 4: "", 5: rows[4][1], 6: rows[5][1]}
    spared = {r.doc_id: r.text for r in ld.remove_repeats(make(rows), least_words=50).collect()}
    assert spared[2] == "" and spared[4] == rows[3][1]


@pytest.mark.parametrize("hash_of", [lambda x: 7, lambda x: 1 + len(x) % 3], ids=["one", "three"])
def test_unlike_lines_under_one_hash(make, hash_of):
    """With hashes that stand for many unlike lines: unlike texts stay, and a true copy among them goes."""
    rng = random.Random(7)
    a, b = (line(rng, 70) for _ in range(2))
    assert {r.doc_id: r.text for r in ld.remove_repeats(make([(1, a), (2, b)]), hash_of).collect()} == {1: a, 2: b}
    assert {r.doc_id: r.text for r in ld.remove_repeats(make([(1, a), (2, b), (3, a)]), hash_of).collect()} == {1: a, 2: b, 3: ""}
    a, b = ("\n".join(line(rng, 5) for _ in range(2)) for _ in range(2))
    assert {r.doc_id: r.text for r in ld.remove_repeats(make([(1, a), (2, b), (3, b), (4, a)]), hash_of).collect()} == {1: a, 2: b, 3: "", 4: ""}
    rows = corpus(9)
    want, _ = repeated(rows)
    for r in ld.remove_repeats(make(rows), hash_of).collect():
        assert set(r["__removed"]) & set(numbered(dict(rows)[r.doc_id])[1]) <= want[r.doc_id]


def test_odd_rows(make, odd):
    docs = make(odd)
    out = ld.remove_repeats(docs)
    assert out.columns == [*docs.columns, "__removed"]
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(str(r[0]) for r in odd)
    assert {r.text for r in out.collect()} == {r[1] for r in odd}
    assert ld.remove_repeats(make([])).count() == 0


def test_unlike_texts_of_one_id_and_long_texts(make):
    rng = random.Random(8)
    passage = "\n".join(line(rng, 12) for _ in range(4))
    long = "\n".join(line(rng, 30) for _ in range(15_000))  # two megabytes
    rows = [(1, passage), (1, passage + "\nown end"), (2, long), (3, long + "\n" + passage)]
    got = sorted((r.doc_id, r.text) for r in ld.remove_repeats(make(rows)).collect())
    assert [i for i, _ in got] == [1, 1, 2, 3]
    assert sorted(t for i, t in got if i == 1) in (sorted([passage, "own end"]), sorted(["", passage + "\nown end"]))
    assert got[2][1] == long and got[3][1] == ""


def test_paragraphs_between_blank_lines(make):
    """Three paragraphs of 30 words, blank lines between them: the passage goes everywhere but in its first place."""
    rng = random.Random(6)
    passage = [line(rng, 30) for _ in range(3)]
    rows = [(i, line(rng, 9) + "\n\n" + "\n\n".join(passage) + "\n" + line(rng, 9)) for i in range(5)]
    rows.append((5, passage[0] + "\n \n\n" + "\n".join(passage[1:])))
    got = {r.doc_id: r for r in ld.remove_repeats(make(rows)).collect()}
    assert got[0].text == rows[0][1]
    assert all(list(got[i]["__removed"]) == [2, 3, 4, 5, 6] for i in range(1, 5)) and got[5].text == ""
