"""The pipeline's near-dedup against all pairs of texts by five-word shingles."""

import random

import numpy as np
import pytest

from quadlark.llm import neardup as nd, simhash as sh


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def corpus(rng):
    rows = []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 5)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randint(0, len(base) // 40)))))
    return rows


def plain_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def slow_groups(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    sets = [(i, plain_shingles(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("group, small", [(nd.GROUP, nd.SMALL), (1, nd.SMALL), (1, 2)])
def test_against_all_pairs(make, monkeypatch, group, small):
    """A small bound of groups takes the way by buckets, a small one of buckets that where a text meets the least of its bucket only."""
    monkeypatch.setattr(nd, "GROUP", group)
    monkeypatch.setattr(nd, "SMALL", small)
    rows = corpus(random.Random(3))
    want = slow_groups(rows)
    got = {r.doc_id: r.component_id for r in nd.groups(make(rows)).collect()}
    if small == nd.SMALL:
        assert got == want
        assert sorted(r.doc_id for r in sh.deduplicate(make(rows)).collect()) == sorted(set(want.values()))
    assert all(want[i] == want[k] for i, k in got.items()) and len(set(got.values())) < len(rows)


def test_unlike_texts_stay(make):
    """Half of the shingles in common is no near copy, though fingerprints may meet."""
    rng = random.Random(4)
    half = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [(i, " ".join(half + [f"v{rng.randrange(5000)}" for _ in range(50)])) for i in range(20)]
    assert len(sh.deduplicate(make(rows)).collect()) == 20


def test_unlike_texts_of_one_id(make):
    """An id that stands for unlike texts loses none of them; which row of a group stays does not depend on the order of rows."""
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (1, b), (1, c), (2, a.upper()), (3, b + " end"), (None, c), (None, "only here"), (None, "Only  here"), (4, None), (5, ""), (1, a)]
    for order in (rows, rows[::-1]):
        got = sorted(((r.doc_id is None, r.doc_id), r.text) for r in sh.deduplicate(make(order).repartition(3)).collect())
        assert got == sorted([((False, 1), a), ((False, 1), b), ((False, 1), c), ((True, None), "Only  here"), ((False, 4), None)])


def test_any_further_names(spark):
    names = "__row __own __t __hash __id __keep root t k none component_id held prints".split()
    rows = [(i, f"one two three four five {i // 2}", *(f"{n}{i}" for n in names)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = sh.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 4, 6]


def test_large_groups_of_unlike_texts(make, monkeypatch):
    """Texts that share fingerprints and are not alike, with a near copy each: no link is lost, and the steps do not grow with their number."""
    rng, steps, real = random.Random(6), [], nd.written
    monkeypatch.setattr(nd, "GROUP", 16)
    monkeypatch.setattr(nd, "SMALL", 2)
    monkeypatch.setattr(nd, "written", lambda df: steps.append(1) or real(df))
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for _ in range(40):
        text = edited(rng, base, 9)
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(edited(rng, text, 1)))]
    want = slow_groups(rows)
    assert len(set(want.values())) > 30
    assert {r.doc_id: r.component_id for r in nd.groups(make(rows)).collect()} == want
    assert len(steps) <= 12


def test_sweep():
    """Sizes on both sides of the bound, and marks: the forest joins what the plain links join."""
    rng = random.Random(7)
    for marked in (False, True):
        sets = []
        for _ in range(60):
            x = rng.sample(range(60), rng.randint(1, 60))
            sets += [np.sort(np.array(x, np.uint64)), np.sort(np.array(x[: max(1, len(x) * 4 // 5)], np.uint64))]
        marks = np.array([rng.randrange(2) for _ in sets]) if marked else None
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(c := set(sets[i]) & set(sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(c)) and (not marked or marks[i] != marks[j])]
        found = nd.forest(sets, marks)
        assert {tuple(sorted(map(int, e), reverse=True)) for e in found} <= set(links) and joined(found, len(sets)) == joined(links, len(sets))


def joined(links, n):
    root = list(range(n))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        x, y = sorted((find(int(a)), find(int(b))))
        root[y] = x
    return [find(x) for x in range(n)]
