"""Fingerprints, keys and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from quadlark.llm import components, simhash as sh


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprint():
    for text in [None, "", "one", "a B c", "a b c d e f g a b c d", "x\x0by\x1cz", "Ä ä A a" * 9]:
        assert sh.fingerprint(text) == slow_fingerprint(text)
    assert sh.fingerprint("w " * 70000) == slow_fingerprint("w w w w")


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1
    assert got == xxhash.xxh64_intdigest(b"a b c d", 42) == sh.fingerprint("a b c d")


def test_codes_cover():
    keys, there = sh.segment_keys(np.random.default_rng(0).integers(0, 1 << 23, 2000))
    assert set(there.sum(axis=1)) == {1, 6}


@pytest.mark.parametrize("bits", range(5))
def test_keys_meet(bits):
    """Any two fingerprints that differ in up to four bits, wherever they are, share a key."""
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for at in rng.choice(64, bits, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(at)
    (ra, ka), (rb, kb) = sh.all_keys(a), sh.all_keys(b)
    for i in range(len(a)):
        assert set(ka[ra == i]) & set(kb[rb == i])


def clusters(n, seed=0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(base)
            for _ in range(rng.randint(0, 4)):
                base ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize("cap", [3, 1 << 16])
def test_links_against_brute_force(spark, cap):
    """Chains of near fingerprints; a small cap takes the way for oversized buckets."""
    fps = sorted(set(clusters(40)))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = {r.node: r.root for r in components.components(sh.links(df, cap=cap)).collect()}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    assert [found.get(x, x) for x in signed] == slow_components(fps, signed)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_near_duplicates(spark, make, odd):
    rng = random.Random(2)
    base = [rng.choice(["red", "green", "blue", "one", "two"]) + str(rng.randrange(50)) for _ in range(300)]
    rows = [*odd, (20, " ".join(base)), (21, " ".join(base).upper()), (22, " ".join(base[:299] + ["end"]))]
    got = sorted(((r.doc_id is not None, r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in sh.near_duplicates(make(rows)).collect())
    fps, ids = [slow_fingerprint(t[1]) for t in rows], [t[0] for t in rows]
    want = slow_components(fps, ids)
    assert got == sorted(((i is not None, i), f, c) for i, f, c in zip(ids, fps, want))
    assert sh.near_duplicates(make([])).count() == 0


def test_one_of_each_group_stays(spark, make, odd):
    kept = sh.deduplicate(make([*odd, (None, "no id here")]))
    assert kept.columns == make([]).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (1, 4, 5, 7)] + [(True, None)]
