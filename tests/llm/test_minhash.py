import random
import re

import numpy as np
import pytest

from quire.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                group[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        c = min(ids) if ids else None
        if not sets[k]:
            c = i
        out.append((i, len(sets[k]), c, c == i))
    return out


key = lambda r: tuple((x is None, str(x)) for x in r)


def result(d):
    return sorted((tuple(r) for r in minhash.near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=key)


def test_against_brute_force(clash):
    assert result(clash) == sorted(brute([tuple(r) for r in clash.select("doc_id", "text").collect()]), key=key)


@pytest.mark.parametrize("block", [1024, 8])
def test_chains_and_groups_of_near_copies(spark, block):
    """Neighbours in a chain are alike and its ends aren't, so that comparing with a key's least member isn't enough."""
    rng = random.Random(9)
    rows, word = [], lambda: f"v{rng.randrange(5000)}"
    for g in range(6):
        text = [word() for _ in range(120)]
        for _ in range(25):
            rows.append((len(rows), " ".join(text)))
            at = rng.randrange(100)
            text = text[:at] + [word().upper() for _ in range(rng.randrange(1, 6))] + text[at + rng.randrange(1, 6) :]
    base = [word() for _ in range(100)]
    for _ in range(60):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(100)] = word()
        rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in minhash.near_duplicates(d, block=block).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_pigeonhole_holds_for_every_pair_in_reach():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, (300, minhash.LENGTH)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.LENGTH, minhash.DISTANCE, replace=False)
        row[at] += rng.integers(1, 1 << 15, len(at)).astype(np.uint16)
    x, y = minhash.keys(a), minhash.keys(b)
    assert (x == y).any(axis=1).all()
    assert ((x == y).argmax(axis=1) == minhash.first_key(a, b)).all()
    assert not (x[:-1] == y[1:]).any()


def of_size(rng, common, union):
    """Two texts of distinct words: the shingles of the shorter are the first `common` of the longer's `union`."""
    w = [f"q{rng.randrange(10**9)}" for _ in range(union + 4)]
    return " ".join(w[: common + 4]), " ".join(w)


@pytest.mark.parametrize(("common", "union"), [(3, 4), (6, 8), (9, 12), (48, 64), (99, 132)])
def test_no_sketch_loses_a_small_pair(common, union):
    rng = random.Random(common)
    for _ in range(2000 if union < 64 else 300):
        a, b = (minhash.shingle_set(t) for t in of_size(rng, common, union))
        x, y = (np.array([minhash.sketch(s)]) for s in (a, b))
        assert minhash.similar(a, b)
        assert minhash.may_link(x, np.array([len(a)]), y, np.array([len(b)]), 75)[0].all()


def test_small_pairs_against_brute_force(spark):
    """Thousands of pairs of similarity 0.75 exactly; a pair may only be missed where the signatures share no key."""
    rng = random.Random(11)
    pairs = [of_size(rng, *shape) for shape in ((3, 4), (6, 8)) for _ in range(2000)]
    d = spark.createDataFrame([(2 * k + m, t) for k, p in enumerate(pairs) for m, t in enumerate(p)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d).collect()}
    want = {}
    for k, p in enumerate(pairs):
        x, y = (minhash.keys(minhash.signature(minhash.shingle_set(t))[None]) for t in p)
        assert all(shingles(p[0]) <= shingles(t) for t in p)
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if (x == y).any() else 2 * k + 1}
    assert got == want


def test_empty(empty):
    assert minhash.near_duplicates(empty).collect() == []
