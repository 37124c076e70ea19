import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import embedding
from quire.llm.common import Workspace
from quire.llm.components import connected_components


def valid(x):
    return bool(x) and all(v is not None and math.isfinite(v) for v in x) and any(x)


def brute(rows, threshold=0.9):
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and valid(rows[a][1]) and valid(rows[b][1]) and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                link[a, b] = x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold
    label = list(range(n))
    for _ in range(n):
        new = [min([label[a], *(label[b] for b in np.flatnonzero(link[a]))]) for a in range(n)]
        if new == label:
            break
        label = new
    out = []
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if label[b] == label[a] and rows[b][0] is not None] if valid(rows[a][1]) else [rows[a][0]]
        c = min(ids) if ids else None
        out.append((rows[a][0], int(link[a].sum()), c, c == rows[a][0]))
    return out


key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, (centre + rng.standard_normal(16) * 0.12 * (k % 3)).tolist()) for k in range(12)]
    base = rng.standard_normal(16).tolist()
    rows += [(1000 + k, base) for k in range(30)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None, *base[1:]]), (2004, [math.nan, *base[1:]]), (2005, [math.inf, *base[1:]]), (2006, base[:8]), (2007, base[:8])]
    rows += [(None, base), (None, None), rows[0]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("i", "e", "good", "cid", "w", "x", "t", "key", "label")})
    got = [tuple(r) for r in embedding.near_duplicates(d.repartition(3), block=block).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_plan_grows_slowly():
    bits, tables = embedding.plan(10**6, 0.9)
    assert bits == 14 and 40 < tables < 60 and embedding.plan(10, 0.9)[0] == 4


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7), (300, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark), "t").collect()))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 120)}, 200: 200, 300: 200}


def test_doubles_stay_doubles(spark):
    """Parallel vectors of components that no float holds, and of which no square is a double's."""
    rows = [(0, [1e39, 0.0]), (1, [2e39, 0.0]), (2, [1.0, 0.0]), (3, [1e-50, 0.0]), (4, [1e300, 1e-300]), (5, [0.0, 1e-200]), (6, [float("inf"), 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 5: (0, 5), 6: (0, 6)}


def test_recall_of_longer_keys(spark):
    """Pairs at a cosine of 0.9005 among so many vectors that keys have eight bits."""
    rng = np.random.default_rng(6)
    n, dim, pairs = 16_000, 32, 2_000
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(pairs):
        a, b = x[2 * k], x[2 * k + 1]
        b = b - (a @ b) * a
        x[2 * k + 1] = 0.9005 * a + np.sqrt(1 - 0.9005**2) * b / np.linalg.norm(b)
    assert embedding.plan(n, 0.9)[0] == 8
    out = embedding.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    root = {r["vec_id"]: r["component_id"] for r in out.collect()}
    assert sum(root[2 * k] == root[2 * k + 1] for k in range(pairs)) >= 0.985 * pairs
