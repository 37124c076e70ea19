import random
import re

import numpy as np
import pytest

from quire.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    least = {}
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("window,levels", [(4, [4]), (7, [4, 7]), (20, [5, 10, 20]), (50, [25, 50]), (130, [33, 65, 130])])
def test_against_brute_force(clash, window, levels):
    shortest = {7: 4, 20: 5}.get(window, 25)
    assert substring.lengths(window, shortest) == levels
    rows = [tuple(r) for r in clash.select("doc_id", "text").collect()]
    got = [tuple(r) for r in substring.dedup(clash, window, shortest).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, window), key=key)


def test_long_repeats_through_all_levels(spark):
    rng = random.Random(8)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(24):
        a = rng.randrange(200)
        part = passage[a : a + rng.choice([40, 100, 129, 130, 131, 190])]
        rows.append((i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(20))] + part + [f"y{rng.randrange(10**6)}" for _ in range(90)])))
    for window in (20, 50, 130):
        got = [tuple(r) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), window, 10).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, window), key=key)


def test_periodic_and_overlapping(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    got = [tuple(r) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 9).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 9), key=key)


def test_a_passage_in_many_documents_and_many_copies(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(5)) + " " + passage) for i in range(80)] + [(100 + i, passage) for i in range(50)]
    got = [tuple(r) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 50), key=key)


def test_empty(empty):
    assert substring.dedup(empty).collect() == []


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 100, 60).astype(np.uint64)
    for width in (1, 2, 5, 26, 60):
        assert substring.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(60 - width + 1)]
    assert len(substring.sliding_min(x, 61)) == 0
